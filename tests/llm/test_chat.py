import duckdb
from pyspark.sql import functions as F

from keyweave.llm import chat, oracle
from keyweave.llm.queries import op7_chat_formatting
from tests.llm.conftest import with_extra

TURN = "conv_id long, turn long, role string, text string"


def test_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    made = op7_chat_formatting(spark, sf_dir)
    want = db.sql(f"SELECT {', '.join(made.columns)} FROM ({oracle.oracle_sql()['op7_chat_formatting']})").fetchall()
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(want, key=str)


def test_only_dataframe_operations(spark, sf_dir):
    plan = op7_chat_formatting(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def rendered(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, rendered(*chosen[:n])]
    for side in (chosen, rejected):
        out.append(rendered(*side[n:]) if side else None)
    for side in (chosen, rejected):
        at, spans = 0, []
        for role, text in side[n:]:
            one = rendered((role, text))
            if role == "assistant":
                spans.append([at + 13 + len(role), len(text) + 10])
            at += len(one)
        out.append(spans if side else None)
    return out


PAIRS = [
    ([("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "\U0001f600d")]),
    ([("user", "q")], [("user", "q"), ("assistant", "b")]), ([("user", "q")], [("user", "q")]), ([("system", "s")], [("user", "s")]), ([("user", "q")], []), ([], [("assistant", "x" * 100_000)]),
]


def test_pairs(spark):
    turns = [(2 * i + k, j, *t) for i, pair in enumerate(PAIRS) for k, side in enumerate(pair) for j, t in enumerate(side)]
    made = chat.pair_conversations(with_extra(spark.createDataFrame(turns, TURN)).repartition(3)).orderBy("pair_id").collect()
    assert [list(r)[1:] for r in made] == [plain(c, r) for c, r in PAIRS]
    first = made[0]
    assert [first.chosen[a : a + n] for a, n in first.chosen_mask] == ["a<|im_end|>"]
    assert [first.rejected[a : a + n] for a, n in first.rejected_mask] == ["b<|im_end|>", "\U0001f600d<|im_end|>"]


def test_nulls_ties_and_repeats(spark):
    turns = [(0, 1, None, "x"), (0, None, "user", None), (0, 1, "b", "y"), (0, 1, "b", "y"), (1, None, "user", ""), (1, 1, "b", "y"), (None, 1, "user", "lost"), (-2, 0, "user", "m"), (-1, 0, "user", "m")]
    made = {r.pair_id: r for r in chat.pair_conversations(spark.createDataFrame(turns, TURN)).collect()}
    assert made[0].n_prompt_turns == 2 and made[0].prompt == rendered(("user", ""), ("b", "y"))
    assert made[0].chosen == rendered(("b", "y"), ("unknown", "x")) and made[0].rejected == ""
    assert made[-1].n_prompt_turns == 1 and made[None].rejected == rendered(("user", "lost"))
    assert chat.pair_conversations(spark.createDataFrame([], TURN)).count() == 0


def test_large_keys_and_no_key(spark, tmp_path):
    """Keys that doubles don't hold pair as others do; turns without a key are not gathered. The same rows by SQL."""
    big = (1 << 53) + 2
    turns = [(k, 0, "user", str(k)) for k in (big, big + 1, big + 3, -1, -2, -3, (1 << 63) - 1)] + [(None, 0, "user", "lost")] * 3
    df = spark.createDataFrame(turns, TURN)
    made = chat.pair_conversations(df).collect()
    assert sorted(r.pair_id for r in made if r.pair_id is not None) == [-2, -1, big // 2, big // 2 + 1, (1 << 62) - 1]
    assert {(r.chosen, r.rejected) for r in made if r.pair_id == big // 2} == {(rendered(("user", str(big))), rendered(("user", str(big + 1))))}
    assert [r.rejected for r in made if r.pair_id is None] == [rendered(("user", "lost"))] * 3
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    made = op7_chat_formatting(spark, str(tmp_path))
    want = db.sql(f"SELECT {', '.join(made.columns)} FROM ({oracle.oracle_sql()['op7_chat_formatting']})").fetchall()
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(want, key=str)


def test_common_prefix_of_arrays(spark):
    df = spark.createDataFrame([([1, None, 3], [1, None, 4]), ([], [1]), ([1, 2], [1, 2])], "a array<int>, b array<int>")
    assert sorted(r[0] for r in df.select(chat.common_prefix(F.col("a"), F.col("b"))).collect()) == [0, 2, 2]
