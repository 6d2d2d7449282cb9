"""Fill-in-the-middle rearrangement of documents, as Column expressions.

A text is cut into lines; two cuts drawn from a digest of the document's id part them into prefix, middle and suffix, which
are joined anew with sentinels in front of each. The cuts depend on the id and the seed only, so reruns agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, unused
from tessera.llm.quality import let


@dataclass(frozen=True)
class Fim:
    """percent: of documents that are rearranged; spm_percent: of those, the share with the suffix first. unit: what a text is
    cut into. Texts that hold a sentinel stay plain, so outputs can be parsed."""

    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[^\n]*\n|[^\n]+"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(id_: Column, seed: int) -> Column:
    """Four whole numbers below 2^32: the first 8-digit groups of the hex sha256 of 'seed:id'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]))


def arranged(text: Column, id_: Column, fim: Fim) -> Column:
    """Struct n, form, prefix_chars, middle_chars, output."""
    has_sentinel = F.lit(False)
    for s in fim.sentinels:
        has_sentinel = has_sentinel | F.contains(text, F.lit(s))

    def plain(n: Column) -> Column:
        nothing = F.lit(None).cast("long")
        return F.struct(n.alias("n"), F.lit("plain").alias("form"), nothing.alias("prefix_chars"), nothing.alias("middle_chars"), text.alias("output"))

    def joined(n: Column, spm: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
        psm = F.concat(F.lit(fim.prefix), prefix, F.lit(fim.suffix), suffix, F.lit(fim.middle), middle)
        turned = F.concat(F.lit(fim.suffix), suffix, F.lit(fim.prefix), prefix, F.lit(fim.middle), middle)
        return F.struct(
            n.alias("n"), F.when(spm, F.lit("spm")).otherwise(F.lit("psm")).alias("form"),
            F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), F.when(spm, turned).otherwise(psm).alias("output"),
        )

    def cut(units: Column, n: Column, h: Column) -> Column:
        ends = F.array_sort(F.array(F.get(h, F.lit(0)) % (n + 1), F.get(h, F.lit(1)) % (n + 1)))

        def parts(at: Column) -> Column:
            low, high = F.get(at, F.lit(0)).cast("int"), F.get(at, F.lit(1)).cast("int")
            piece = lambda start, length: F.array_join(F.slice(units, start, length), "")
            pieces = F.array(piece(F.lit(1), low), piece(low + 1, high - low), piece(high + 1, F.size(units) - high))
            return let(pieces, lambda p: joined(n, F.get(h, F.lit(3)) % 100 < fim.spm_percent, F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))))

        return let(ends, parts)

    def of_units(units: Column) -> Column:
        n = F.size(units).cast("long")
        return let(draws(id_, fim.seed), lambda h: F.when((n == 0) | has_sentinel | (F.get(h, F.lit(2)) % 100 >= fim.percent), plain(n)).otherwise(cut(units, n, h)))

    return let(F.regexp_extract_all(text, F.lit(fim.unit), F.lit(0)), of_units)


def restored(output: Column, form: Column, fim: Fim) -> Column:
    """The text from which output was arranged: the parts between its sentinels in their order. Each sentinel occurs once."""
    any_sentinel = "|".join(re.escape(s) for s in fim.sentinels)

    def of_parts(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        return F.when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))

    return F.when(form == "plain", output).otherwise(let(F.split(output, any_sentinel), of_parts))


def fill_in_middle(docs: DataFrame, fim: Fim | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars and output in a struct column
    'fim' (or 'fim_', ... where docs has that column).

    A null text is empty: no units, plain. A null id draws as the empty string does, so such rows share their draws. Very long
    texts are cut whole; repeated rows give equal outputs; an empty table gives an empty one. Columns of docs stay as they are.
    """
    fim = fim or Fim()
    return docs.withColumn(unused(docs, "fim"), arranged(doc_text(text_col), F.col(id_col), fim))
