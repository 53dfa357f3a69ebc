"""What the near-duplicate join leaves on the executors' disks."""

import time

from vitrine.llm import jaccard, storage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(storage.CLEANUP, "false")
    out = storage.stored(spark.range(1000).repartition(5, "id"))
    for _ in range(50):  # they go in the background
        if (left := shuffle_files(spark)) <= before:
            break
        time.sleep(0.1)
    assert left <= before and spark.conf.get(storage.CLEANUP, "false") == setting
    assert out.count() == 1000


def test_many_members_are_taken_in_rounds(spark, monkeypatch):
    """Texts of members are never shuffled for a join with too many ids; links are those of one round."""
    texts = [f"{' '.join(f'w{g}x{k}' for k in range(80))} {'tail' if c else 'end'}" for g in range(40) for c in range(3)] + [None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(jaccard.linked_components(df).collect())
    made = []
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 9)
    monkeypatch.setattr(jaccard, "stored", lambda table, what: made.append((what, table._jdf.queryExecution().toString())) or storage.stored(table, what))
    assert sorted(jaccard.linked_components(df).collect()) == want
    assert [r.component_id for r in want[:6]] == [0, 0, 0, 3, 3, 3]
    rounds = [plan for what, plan in made if what == "links"]
    assert len(rounds) == 9  # 80 members, of two sets a text
    # The texts meet the ids by a broadcast.
    assert all("doc_id" not in line for plan in rounds for line in plan.split("== Physical Plan ==")[1].splitlines() if "SortMergeJoin" in line)
