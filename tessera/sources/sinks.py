"""JSON, Markdown and report outputs. Rendering is Column expressions; the small published file is one atomic rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.normalize import sort_year
from tessera.functions.text import blank, first_filled, text
from tessera.operators.sections import added_up, placed

LABELS = (("Year", "year"), ("Type", "type"), ("Materials", "materials"), ("Size", "size"), ("Duration", "duration"), ("Video", "video_link"))


def heading(title: Column, url: Column, title_cn: Column) -> Column:
    plain = F.concat(F.lit("### ["), text(title), F.lit("]("), text(url), F.lit(")"))
    return F.when(blank(title_cn), plain).otherwise(F.concat(plain, F.lit(" / "), text(title_cn)))


def work_markdown(row: dict[str, Column], labels: tuple[tuple[str, str], ...] = LABELS) -> Column:
    """A work's entry: heading, one line for each filled field, then descriptions."""
    lines = [F.when(~blank(row[f]), F.concat(F.lit(f"- **{name}**: "), text(row[f]))) for name, f in labels]
    prose = [F.when(~blank(row[f]), F.concat(F.lit("\n"), text(row[f]))) for f in ("description_en", "description_cn")]
    return F.concat_ws("\n", heading(row["title"], row["url"], row["title_cn"]), *lines, *prose)


def portfolio_markdown(works: DataFrame, order: str = "_ordinal") -> DataFrame:
    """place, text: entries by falling year, with a header wherever the year changes. Equal years keep their order."""
    df = placed(works, "year", sort_year("year"), order)
    entry = work_markdown({f: F.col(f) for f in ("title", "url", "title_cn", "year", "type", "materials", "size", "duration", "video_link", "description_en", "description_cn")})
    head = F.when(F.col("is_break"), F.concat(F.lit("## "), text("year"), F.lit("\n\n"))).otherwise(F.lit(""))
    return df.select("place", F.concat(head, entry).alias("text"))


def _row(label: str, value: Column) -> Column:
    return F.when(~blank(value), F.concat(F.lit(f"| {label} | "), text(value), F.lit(" |\n"))).otherwise("")


def _images(images: Column, head: str, each) -> Column:
    listed = F.coalesce(images, F.array().cast("array<string>"))
    return F.when(F.size(listed) > 0, F.concat(F.lit(head), F.array_join(F.transform(listed, each), ""))).otherwise("")


def _framed(src: Column) -> Column:
    return F.concat(F.lit('<a href="'), src, F.lit('" target="_blank"><img src="'), src, F.lit('" width="400"></a>\n\n'))


def _some(row: dict[str, Column], *names: str) -> Column:
    """The first of the image lists that has any."""
    out = F.array().cast("array<string>")
    for n in reversed(names):
        out = F.when(F.coalesce(F.size(row[n]), F.lit(0)) > 0, row[n]).otherwise(out)
    return out


def _headed(row: dict[str, Column]) -> Column:
    return F.when(blank(row["title_cn"]) | (row["title_cn"] == row["title"]), text(row["title"])).otherwise(F.concat(text(row["title"]), F.lit(" / "), text(row["title_cn"])))


def report_item(row: dict[str, Column], place: Column, local: Column | None = None) -> Column:
    """An item of an extraction report: its number and titles, a table of filled fields, descriptions and images; or what went
    wrong. local: map from images' addresses to files; those without a file are shown from where they are."""
    number = F.concat(F.lit("## "), place.cast("string"), F.lit(". "))
    link = F.concat(F.lit("["), text(row["url"]), F.lit("]("), text(row["url"]), F.lit(")"))
    failed = F.concat(
        number, F.lit("❌ Extraction Failed / 提取失败: "), text(row["title"]), F.lit("\n\n> **Error / 错误:** "), text(row["error"]), F.lit("\n> **URL / 链接:** "), link, F.lit("\n\n---\n\n")
    )
    kind = first_filled(row["category"], row["type"]) if "category" in row else text(row["type"])
    video = F.when(~blank(row["video_link"]), F.concat(F.lit("["), row["video_link"], F.lit("]("), row["video_link"], F.lit(")")))
    fields = (("Year / 年份", row["year"]), ("Type / 类型", kind), ("Video / 视频", video), ("Materials / 材料", row["materials"]), ("Size / 尺寸", row["size"]), ("Duration / 时长", row["duration"]))
    prose = [F.when(~blank(row[f]), F.concat(F.lit(f"**{name}:**\n\n"), text(row[f]), F.lit("\n\n"))).otherwise("") for name, f in (("English", "description_en"), ("中文", "description_cn"))]
    described = F.when(~blank(row["description_en"]) | ~blank(row["description_cn"]), F.lit("### Description / 描述\n\n")).otherwise("")
    place_of = lambda u: u if local is None else F.coalesce(F.concat(F.lit("./"), F.try_element_at(local, u)), u)
    images = _images(_some(row, "high_res_images", "images"), "### Images / 图片\n\n", lambda u: _framed(place_of(u)))
    done = F.concat(number, _headed(row), F.lit("\n\n"), *[_row(n, c) for n, c in fields], F.lit("\n"), described, *prose, images, F.lit("---\n\n"))
    return F.when(~blank(row["error"]), failed).otherwise(done)


def image_files(items: DataFrame, folder: str = "images", split: bool = False) -> DataFrame:
    """item (_ordinal of the first that has it, or of each with split), url, file: images numbered in order, each address once."""
    listed = items.select("_ordinal", F.posexplode(_some({c: F.col(c) for c in ("high_res_images", "images")}, "high_res_images", "images")).alias("at", "url"))
    by = ["_ordinal", "url"] if split else ["url"]
    once = listed.groupBy(*by).agg(F.min(F.struct("_ordinal", "at")).alias("first"))
    ext = F.regexp_extract(F.substring_index(F.col("url"), "?", 1), r"(\.[^./]+)$", 1)
    within = Window.partitionBy("first._ordinal").orderBy("first.at")
    if split:  # numbered by their place in the item's list
        number = F.col("first.at") + 1
    else:  # numbered through: per-item counts first, then their running total over items
        counts = once.groupBy(F.col("first._ordinal").alias("_o")).agg(F.count("*").alias("_n"))
        before = added_up(counts, "_n", "_o", "_b").drop("_n")
        once = once.join(before, F.col("first._ordinal") == F.col("_o"))
        number = F.col("_b") + F.row_number().over(within)
    file = F.concat(F.lit(folder + "/"), F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0")), F.when(ext == "", ".jpg").otherwise(ext))
    return once.select(F.col("first._ordinal").alias("item"), "url", file.alias("file"))


def rich_markdown(row: dict[str, Column]) -> Column:
    """A work with all its fields and images."""
    fields = (("Year", "year"), ("Type", "type"), ("Materials", "materials"), ("Size", "size"), ("Duration", "duration"), ("Video", "video_link"), ("URL", "url"), ("中文描述", "description_cn"), ("Description", "description_en"))
    lines = [F.when(~blank(row[f]), F.concat(F.lit(f"**{n}**: "), text(row[f]), F.lit("\n\n"))).otherwise("") for n, f in fields]
    return F.concat(F.lit("## "), _headed(row), F.lit("\n\n"), *lines, _images(_some(row, "images", "high_res_images"), "### 图片\n\n", _framed), F.lit("---\n\n"))


def web_images_report(works: DataFrame, order: str = "_ordinal") -> DataFrame:
    """sort_key, _ordinal, text: works by falling year with links to their images; write them in that order."""
    c = {f: text(f) for f in ("title", "title_cn", "year", "url", "type", "description_en", "description_cn")}
    lit = F.lit
    line = lambda before, f, after: F.when(~blank(c[f]), F.concat(lit(before), c[f], lit(after))).otherwise("")
    images = _images(F.col("images"), "### Images\n\n", lambda u: F.concat(lit("![]("), u, lit(")\n\n")))
    body = F.concat(
        lit("## "), c["year"], lit(" - "), c["title"], line(" / ", "title_cn", ""), lit("\n\n**URL**: ["), c["url"], lit("]("), c["url"], lit(")\n\n"), line("**Type**: ", "type", "\n\n"),
        line("> ", "description_cn", "\n\n"), line("", "description_en", "\n\n"), images, lit("---\n"),
    )
    return works.select(sort_year("year").alias("sort_key"), order, body.alias("text")).orderBy(F.desc("sort_key"), order)


def error_entry(url: Column, error: Column) -> Column:
    return F.concat(F.lit("### "), text(url), F.lit("\n\n> Error: "), text(error))


def write_json_rows(df: DataFrame, path: str) -> None:
    """One object a line, any size."""
    df.write.mode("overwrite").json(path)


def write_one_file(spark: SparkSession, lines: DataFrame, order: str, column: str, path: str, before: str = "", after: str = "", between: str = "\n") -> None:
    """The rows' texts in one file, for artifacts of a known small size: written beside path, then renamed.

    Rows come to the driver one partition at a time.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(before.encode()))
    for i, row in enumerate(lines.orderBy(order).select(column).toLocalIterator()):
        out.write(bytearray(((between if i else "") + (row[0] or "")).encode()))
    out.write(bytearray(after.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} could not be put in place")


def write_works_json(works: DataFrame, path: str, order: str = "_ordinal") -> None:
    """One JSON array, unescaped UTF-8."""
    fields = [c for c in works.columns if c != order]
    rows = works.select(F.col(order), F.to_json(F.struct(*fields)).alias("_json"))
    write_one_file(works.sparkSession, rows, order, "_json", path, "[\n  ", "\n]\n", ",\n  ")


def write_portfolio(works: DataFrame, path: str, title: str = "# Portfolio", order: str = "_ordinal") -> None:
    write_one_file(works.sparkSession, portfolio_markdown(works, order), "place", "text", path, title + "\n\n", "\n", "\n\n")


def check_works(works: DataFrame) -> None:
    """A published table must not be empty, nor have rows without a URL."""
    row = works.agg(F.count("*").alias("n"), F.count_if(blank("url")).alias("blank")).first()
    if not row["n"] or row["blank"]:
        raise ValueError(f"{row['n']} works, {row['blank']} without a URL")
