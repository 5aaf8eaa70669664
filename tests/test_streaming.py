"""A stream gets the codes that a batch gets."""

from tessera.plans.model import PQModel
from tessera.streaming.encode import encode_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "in"))
    model = PQModel(4, parts=2, ks=4, max_steps=2).fit(rows)
    stream = encode_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: sorted((r.vec_id, r.codes) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(model.encode(rows))
