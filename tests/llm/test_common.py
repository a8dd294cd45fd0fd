"""Workers give back what operators before them remember."""

import pyarrow as pa

from graphloom.llm import common


def test_kernel_drops_what_others_remember(spark):
    def one(n):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def fill(batches):
        for _ in batches:
            common.REMEMBERED.setdefault("one", {})["word"] = b"ids"
            common.powers(1000)
            yield one(len(common.REMEMBERED))

    def look(batches):
        for _ in batches:
            yield one(len(common.REMEMBERED))

    def sizes(batches):
        for _ in batches:
            yield one(len(common._powers[0]))

    rows = spark.range(0, 64, 1, 8)
    seen = lambda f: {r.n for r in rows.mapInArrow(f, "n long").collect()}
    assert seen(common.kernel(fill, "one")) == {1}
    assert 1 in seen(look)  # a worker still has it
    assert seen(common.kernel(look)) == {0}
    assert seen(sizes) == {1}
