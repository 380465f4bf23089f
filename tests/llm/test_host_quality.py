import random

from oracle import same_as_sql
from pairshift.llm import host_quality as hq


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)})


def test_whole_table(spark):
    assert same_as_sql(spark, "op4_host_quality") == 1000


def test_repeat_words_both_ways():
    r = random.Random(1)
    for _ in range(150):
        words = [r.choice("ab") * r.randint(1, 2) for _ in range(r.randint(0, 60))]
        want = brute_repeats(words)
        assert hq.repeat_words(words) == want
        if len(words) > 6:
            assert hq._repeat_words_arrays(words) == want


def test_counts_by_hand():
    assert hq.base_counts("") == (0, 0, 0, 0, 0)
    assert hq.base_counts(" é\u00a0b #|\n\n x \nx\n x \n") == (5, 8, 2, 1, 0)


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS host", "2 AS kept", "3 AS host_of_row")


GOOD = "one two three four five six seven eight nine ten eleven"


def test_bad_host_goes_small_host_and_null_host_stay(spark):
    rows = [(i, GOOD if i % 10 == 0 else "bad", "junk.example") for i in range(200)]
    rows += [(1000 + i, GOOD if i % 20 else "bad", f"host{i % 9}") for i in range(900)]
    rows += [(5000, "bad", "tiny"), (5001, GOOD, "tiny"), (6000, GOOD, None), (6001, None, None), (6002, "", "host1"), (6000, GOOD, None)]
    got = hq.host_quality(make(spark, rows)).collect()
    by = {(r["id"], r["host"]): r for r in got}
    assert len(got) == len(rows)
    assert not by[0, "junk.example"]["kept"] and not by[0, "junk.example"]["base_failed"]
    assert by[1001, "host1"]["kept"] and by[5001, "tiny"]["kept"] and by[6000, None]["kept"]
    assert not by[6001, None]["kept"] and not by[6002, "host1"]["kept"]
    kept = hq.drop_low_quality(make(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "host", "kept", "host_of_row"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["id"]) for r in got if r["kept"])


def test_prior():
    assert hq.beta_prior(0, 0, 0, 0) == (1.0, 1.0)
    a, b = hq.beta_prior(10, 1000, 100, 10.0)  # all hosts alike: strongest prior, mean 0.1
    assert abs(a / (a + b) - 0.1) < 1e-9 and a + b == 1e6


def test_empty_table(spark):
    empty = make(spark, [])
    assert hq.host_quality(empty).count() == 0 and hq.drop_low_quality(empty).count() == 0
