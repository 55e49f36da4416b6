from datetime import datetime

from pyspark.sql import functions as F

from mesalith.streaming import cells


def test_block_means(spark, tmp_path):
    rows = [("a", r, c, float(r * 4 + c), datetime(2024, 1, 1, 0, r)) for r in range(4) for c in range(4)]
    spark.createDataFrame(rows, cells.CELLS).write.parquet(str(tmp_path / "in"))
    q = (cells.block_means(cells.read_cells(spark, str(tmp_path / "in")), 2).select("row", "col", "z", "n").writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.row, r.col): (r.z, r.n) for r in spark.table("means").collect()}
    assert got[0, 0] == ((0 + 1 + 4 + 5) / 4, 4) and len(got) == 4
    assert spark.table("means").where(F.col("n") != 4).count() == 0
