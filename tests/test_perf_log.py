import random

import pytest
from pyspark.sql import functions as F

from opslens.operators import perf
from opslens.sinks import tables
from opslens.sources import perf_log

LOG = """MongoDB shell version: 2.7.5-pre-
connecting to: 127.0.0.1:27017/test
db version: 2.6.5-rc2-pre-
2966c35b20416d55c3d481e5f254a9befb1b2338

load('shared/helper.js')

Geo.within.center
1\t928.11
2\t1839.5
2\t1861.5
Geo.within.center.offcenter
1\t818.7
Wide_name-1
4\t10.0
Wide.two_
4\t20.0
not an id
5\t30.0
Finished Testing."""


def plain(df):
    return sorted((r.name, r.thread, r.result) for r in df.collect())


@pytest.mark.parametrize("chunk", [1, 2, 5, 100])
def test_samples_of_a_log(lines, chunk):
    got = plain(perf_log.perf_samples(lines(LOG, chunk=chunk)))
    # The wide name clears the current name; the next wide name is then taken.
    assert got == [("Geo.within.center", 1, 928.11), ("Geo.within.center", 2, 1839.5), ("Geo.within.center", 2, 1861.5),
                   ("Geo.within.center.offcenter", 1, 818.7), ("Wide.two_", 4, 20.0)]


def test_info(lines):
    (info,) = perf_log.perf_log_info(lines(LOG)).collect()
    assert info.client_version == "MongoDB shell version: 2.7.5-pre-"
    assert (info.version, info.server_version) == ("db version: 2.6.5-rc2-pre-", "2.6.5-rc2-pre-")
    assert info.git_sha == "2966c35b20416d55c3d481e5f254a9befb1b2338" and not info.conflict


def test_conflicting_versions(lines):
    two = lines("db version: 1\nabc\ndb version: 2\ndef")
    (info,) = perf_log.perf_log_info(two).collect()
    assert info.conflict and info.git_sha == "def"
    with pytest.raises(Exception, match="versions differ"):
        perf_log.perf_log_info(two, strict=True).collect()


WORDS = ["db version: 2.7.5", "MongoDB shell version: 2", "Alpha", "Beta.1", "wide_one", "wide-two", "5\t1.5",
         "12 2.25  x", "7\tx", "not an id", "", "2966c35b", "{ a: 1 }"]


def by_hand(texts):
    """The samples of a log, reading one line after the other."""
    import re
    out, current, skip = [], None, False
    for text in texts:
        if skip:
            skip = False
        elif text.startswith("MongoDB shell version: "):
            pass
        elif text.startswith("db version: "):
            skip = True
        elif current is None:
            if re.fullmatch(r"[a-zA-Z.0-9_-]+", text):
                current = text
        elif re.match(r"[0-9]+\s+[0-9.]+", text):
            thread, result = text.split()[:2]
            out.append((current, int(thread), float(result)))
        else:
            current = text if re.fullmatch(r"[a-zA-Z.0-9]+", text) else None
    return sorted(out)


def test_random_logs_in_small_chunks(spark, lines):
    rng = random.Random(5)
    logs = {f"log{i}": rng.choices(WORDS, weights=[4, 1, 2, 2, 3, 3, 5, 2, 0, 2, 1, 1, 1], k=rng.randint(1, 25))
            for i in range(1500)}
    got = {}
    for row in perf_log.perf_samples(lines(logs, chunk=4)).collect():
        got.setdefault(row.file, []).append((row.name, row.thread, row.result))
    for name, texts in logs.items():
        assert sorted(got.get(name, [])) == by_hand(texts), texts


SAMPLES = [("old", "A", 5, 100.0), ("old", "A", 5, 102.0), ("old", "B", 5, 50.0), ("old", "B", 5, 60.0), ("old", "C", 1, 1.0),
           ("new", "A", 5, 90.0), ("new", "A", 5, 92.0), ("new", "B", 5, 58.0), ("new", "D", 1, 7.0)]


def test_mean_and_cv(spark):
    samples = spark.createDataFrame(SAMPLES, "file STRING, name STRING, thread INT, result DOUBLE")
    rows = {(r.file, r.name): r for r in perf.mean_cv(samples).collect()}
    a = rows["old", "A"]
    assert a.mean == 101.0 and abs(a.cv - 100 * 2 ** 0.5 / 101) < 1e-12 and a.cv_str == "1.40%"
    assert rows["new", "D"].cv is None and rows["new", "D"].cv_str == "n/a"


def test_compare_both_ways(spark):
    samples = spark.createDataFrame(SAMPLES, "file STRING, name STRING, thread INT, result DOUBLE")
    of = lambda f: perf.mean_cv(samples.where(F.col("file") == f))
    joined = sorted(map(str, perf.compare(of("old"), of("new")).collect()))
    single = sorted(map(str, perf.compare_files(samples, "old", "new").collect()))
    assert joined == single
    rows = {r.key: r for r in perf.compare_files(samples, "old", "new").collect()}
    assert set(rows) == {"A_TH-005", "B_TH-005", "D_TH-001"}
    assert rows["A_TH-005"].regression and rows["A_TH-005"].delta == "-9.90%"
    assert not rows["B_TH-005"].regression and rows["B_TH-005"].old_noisy and not rows["B_TH-005"].new_noisy
    assert rows["D_TH-001"].old_mean is None and not rows["D_TH-001"].regression


@pytest.mark.parametrize("cv, noisy", [(2.99, False), (3.0, False), (3.09, False), (3.094, False), (3.1, True), (9.0, True)])
def test_noise_reads_one_decimal(spark, cv, noisy):
    row = spark.createDataFrame([("A", 1, 100.0, cv, "x", 100.0, cv, "x")],
                                "name STRING, thread INT, old_mean DOUBLE, old_cv DOUBLE, old_cv_str STRING, "
                                "new_mean DOUBLE, new_cv DOUBLE, new_cv_str STRING")
    assert perf._flags(row).first().new_noisy is noisy


def test_tables(spark):
    samples = spark.createDataFrame(SAMPLES, "file STRING, name STRING, thread INT, result DOUBLE")
    compared = perf.compare_files(samples, "old", "new")
    text = [r.value for r in tables.text_table(compared, aligned=False).collect()]
    assert text == ["A_TH-005\t101.00[1.40%]\t91.00[1.55%]\t-9.90%", "B_TH-005\t55.00[12.86%]\t58.00[n/a]\t+5.45%",
                    "D_TH-001\tn/a\t7.000000[n/a]\tn/a"]
    wiki = [r.value for r in tables.text_table(compared, wiki=True).collect()]
    padded = lambda *cells: "".join(c.ljust(w) for c, w in zip(cells, (16, 21, 33, 16, 13))) + cells[-1]
    assert wiki[0] == padded("||benchmark", "||baseline ns/op", "||cv baseline", "||new ns/op", "||cv new", "||delta|")
    assert wiki[1] == padded("||A_TH-005", "|101.00", "|1.40%", "|91.00", "|1.55%", "|{color:red}-9.90%{color}|")
    assert wiki[2] == padded("||B_TH-005", "|55.00", "|{color:orange}12.86%{color}", "|58.00", "|n/a", "|+5.45%|")
    assert "|7.000000" in wiki[3] and wiki[3].endswith("|n/a|")


def test_speedup_text(spark):
    assert spark.range(1).select(perf.speedup_text(F.lit(1.256))).first()[0] == "1.26x"
