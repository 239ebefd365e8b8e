from keyloom.llm import jaccard
from tests.llm import brute
from tests.llm.test_jaccard import corpus


def test_small_tables_between_steps_take_few_tasks(spark):
    """The driver keeps an account of every task: with 40 shuffle partitions that nothing merges, a step must not read 40 nearly empty parts, or those of all rounds before."""
    rows, group, tracker = corpus(6, 40), "driver load", spark.sparkContext.statusTracker()
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), n=5, num=80, den=100).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute.components(rows, 5, 80, 100))
    stages = {i: tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(s.numCompletedTasks for s in stages.values() if s) < 2500  # 1,679; 4,103 where checkpoints kept the number of partitions
