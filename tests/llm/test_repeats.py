"""The verdict of the quality rules on texts that pass the base rule."""

from veil.llm import quality


def test_repeats_fail_by_the_method(spark):
    fresh = iter(range(10**6))

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    def text(n_words, passage, times):
        """n_words words, of which a passage of so many words stands so many times."""
        p, out = words(passage), []
        for _ in range(times):
            out += p + words((n_words - passage * times) // times)
        return " ".join(out)

    rows = [(1, text(1000, 20, 2)), (2, text(1000, 90, 2)), (3, text(1000, 15, 20)), (4, " ".join(text(1000, 100, 4) for _ in range(20))), (5, " ".join(words(1000)))]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i: r["n_covered"] / r["n_words"] for i, r in got.items()} == {1: 0.04, 2: 0.18, 3: 0.3, 4: 0.4, 5: 0.0}
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True}
