import duckdb
import pytest

from keyweave.llm import oracle, quality
from tests.llm.conftest import DOCUMENT, with_extra

NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines"]


def by_sql(path):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return sorted(db.sql(f"SELECT {', '.join(NAMES)} FROM ({oracle.oracle_sql()['op3_quality_rules']})").fetchall(), key=str)


def test_against_sql(documents, sf_dir):
    made = quality.judge_quality(documents)
    assert made.columns == NAMES
    assert sorted((tuple(r) for r in made.collect()), key=str) == by_sql(f"{sf_dir}/documents.parquet")


def test_odd_rows(spark, odd, no_documents, tmp_path):
    odd.coalesce(1).write.parquet(str(tmp_path / "odd"))
    want = by_sql(str(tmp_path / "odd" / "*.parquet"))
    assert sorted((tuple(r) for r in quality.judge_quality(odd).collect()), key=str) == want
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r[7] for r in want)
    assert quality.judge_quality(no_documents).count() == quality.keep_quality(no_documents).count() == 0


@pytest.mark.parametrize(
    ("text", "counts"),
    [
        (None, (0, 0, 0, 0, 0, 0)), ("a b c a b c", (6, 6, 0, 0, 6, 1)), ("a a a a", (4, 4, 0, 0, 4, 1)), ("a b c x a b c b c", (9, 9, 0, 0, 6, 1)),
        ("#a $|\n\n x\n x\nx", (5, 7, 3, 1, 0, 4)), ("\u00a0 \u00e9\u20ac", (2, 3, 0, 0, 0, 1)), ("\n\n", (0, 0, 0, 0, 0, 0)), ("a\r\na\r\na", (3, 3, 0, 1, 0, 3)),
    ],
)
def test_counts(text, counts):
    assert quality.count_text(text) == counts


def test_fences_follow_each_source(spark):
    """Where many documents are tables, tables stay; where none is, a lone one goes."""
    plain = " ".join(f"w{i}ord" for i in range(60))
    table = " ".join(f"w{i} |" for i in range(60))
    rows = [(i, plain, "en", "prose", 1) for i in range(60)] + [(100, table, "en", "prose", 1)]
    rows += [(200 + i, table if i % 2 else plain, "en", "tables", 1) for i in range(60)] + [(300, table, "en", "rare", 1)]
    kept = {r.doc_id: r.kept for r in quality.judge_quality(with_extra(spark.createDataFrame(rows, DOCUMENT))).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100]
    assert all(kept[200 + i] for i in range(60))
    assert kept[300]  # too few documents of its own: the language's fences hold, and half of these are tables


def test_sketch_error_is_bounded(spark):
    df = spark.range(5000).selectExpr("id * id AS v")
    for r in df.select("v", quality._leading(df["v"]).alias("b")).collect():
        assert 0 <= r.v - r.b <= r.v / 32


def test_small_groups_follow_their_language_by_degrees(spark):
    """One rule for all sizes: the fence of n like documents beside a language of others moves from the language's to their own."""
    plain, odd_ones = " ".join(f"w{i}ord" for i in range(60)), " ".join(f"w{i} |" for i in range(60))
    kept = []
    for n in (5, 9, 11, 40):
        rows = [(i, plain, "en", "prose", 1) for i in range(400)] + [(1000 + i, odd_ones, "en", "tables", 1) for i in range(n)]
        made = quality.judge_quality(spark.createDataFrame(rows, DOCUMENT)).where("doc_id >= 1000").select("kept").distinct().collect()
        kept.append([r.kept for r in made])
    assert kept == [[False], [False], [True], [True]]  # a quarter of n + PRIOR documents


def test_labelled_documents(spark):
    """Junk goes and good documents stay, of those that pass the base rules."""
    folder = "/root/testdata/sf0.01"
    judged = quality.judge_quality(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    found = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").agg({"*": "count", "kept": "min"}).collect()
    shares = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").selectExpr("quality", "cast(kept as int) as k").groupBy("quality").agg({"k": "avg"}).collect()
    assert len(found) == 2 and {r.quality: r["avg(k)"] for r in shares} == {0: 0.0, 1: 1.0}


def test_texts_are_counted_once(spark, tmp_path):
    """Rows to keep are counted once, though sketches and fences both need the counts."""
    log = tmp_path / "counted"
    log.mkdir()
    before = quality.count_text

    def counting(text):
        import uuid

        (log / uuid.uuid4().hex).touch()
        return before(text)

    import keyweave.llm.quality as module

    counted = module.COUNTS
    rows = spark.createDataFrame([(i, " ".join(f"w{j}ord" for j in range(60 + i)), "en", "a", 1) for i in range(50)], DOCUMENT)
    old = module._count

    def _count(texts):
        import pandas as pd

        return pd.DataFrame([counting(t) for t in texts], columns=[c.split()[0] for c in counted.split(", ")], dtype="int64")

    module._count = _count
    try:
        assert module.keep_quality(rows).count() == 50
    finally:
        module._count = old
    assert len(list(log.iterdir())) == 50
