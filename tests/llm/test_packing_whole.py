def test_boundaries_of_long_lengths_have_the_least_padding(spark):
    from itertools import combinations

    from tessera.llm.packing import Packing, boundaries

    sizes = [20_000, 20_001, 20_001, 20_001, 20_040, 20_041, 1_000, 1_001, 1_001, 600]
    tops = sorted(set(sizes))
    pad = lambda ends: sum(next(e for e in ends if e >= x) - x for x in sizes)
    for k in range(2, 6):
        ends = boundaries(spark.createDataFrame([(x,) for x in sizes], "size long"), Packing(buckets=k))
        assert pad(ends) == min(pad([*c, tops[-1]]) for c in combinations(tops[:-1], k - 1))
