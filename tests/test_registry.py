import shutil

from linklake.functions.text import explode_tokens
from linklake.plans.registry import QUERIES

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def test_distinct_messages_of_a_folder_of_files_and_of_one_file(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "a"), (1, 3, "user", "c"), (2, 0, "user", "a"), (3, 0, "assistant", "a")]
    made = spark.createDataFrame(rows, CONVERSATIONS)
    folder, single, none = tmp_path / "folder", tmp_path / "single", tmp_path / "none"
    made.repartition(3).write.parquet(str(folder / "conversations.parquet"))
    made.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    shutil.copy(next((tmp_path / "one").glob("part-*.parquet")), single / "conversations.parquet")
    made.filter("conv_id > 9").write.parquet(str(none / "conversations.parquet"))
    run = lambda d: sorted(map(tuple, QUERIES["stream_distinct_messages"](spark, str(d)).collect()))
    assert run(folder) == run(single) == [("1", 2), ("2", 1)]
    assert run(none) == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_compiled_and_complete(spark):
    text = "Re-sized foo.bar/ab.c_de buses 动画 动 动画编辑器工具 thing-s x86+ stories"
    got = sorted(r.token for r in explode_tokens(spark.createDataFrame([(1, text)], "id int, text string"), "text").collect())
    run = ["re-sized", "sized", "foo.bar", "foo", "bar", "ab.c_de", "buses", "buse", "thing-s", "thing", "x86+", "x86", "stories", "story"]
    cjk = ["动画", "动画", "动", "动", "动画", "画编", "编辑", "辑器", "器工", "工具"]
    assert got == sorted(run + cjk)
    assert "lambdafunction" not in _plan(explode_tokens(spark.createDataFrame([(1, text)], "id int, text string"), "text"))


def test_shared_tables_are_written_down_once(spark, data):
    assert "documents" not in _plan(QUERIES["post_library"](spark, data)) and "posexplode" not in _plan(QUERIES["post_library"](spark, data))
    assert "Generate" not in _plan(QUERIES["recall_recent"](spark, data))
