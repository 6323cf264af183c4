"""Two streams in any order give the batch result, each pair once."""

import random

import pytest

from tenderlake.operators.alerts import match_alerts
from tenderlake.streaming.interests import PROVIDER, alert_stream

PUBLICATION, INTEREST = "publication_id long, domaine_id long", "entreprise_id long, domaine_id long"


@pytest.fixture
def settings(spark):
    """A trigger that ends would go on for ever with batches that only let time pass."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.unset(PROVIDER)


@pytest.mark.parametrize("seed", [1, 2])
def test_replayed_streams_give_the_batch_result_once(spark, settings, tmp_path, seed):
    dice = random.Random(seed)
    draw = lambda n, ids: [(dice.randrange(ids), dice.choice([None, *range(6)])) for _ in range(n)]
    publications, interests = draw(60, 25), draw(40, 15)
    for name, schema in (("p", PUBLICATION), ("i", INTEREST)):
        (tmp_path / name).mkdir()
    stream = alert_stream(spark.readStream.schema(PUBLICATION).json(f"file://{tmp_path}/p"), spark.readStream.schema(INTEREST).json(f"file://{tmp_path}/i"))
    for round_ in range(3):
        # Either side may come alone; the last round repeats rows of the first.
        part = lambda rows: rows[round_ * 20 : round_ * 20 + 20] + (rows[:5] if round_ == 2 else [])  # noqa: E731, B023
        for name, schema, rows in (("p", PUBLICATION, part(publications) if round_ != 1 else []), ("i", INTEREST, part(interests) if round_ else [])):
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/{name}")
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    sent = [r for n in (0, 2) for r in publications[n * 20 : n * 20 + 20]], [r for n in (1, 2) for r in interests[n * 20 : n * 20 + 20]]
    sent = sent[0] + publications[:5], sent[1] + interests[:5]
    want = match_alerts(spark.createDataFrame(sent[0], PUBLICATION), spark.createDataFrame(sent[1], INTEREST))
    got = [tuple(r) for r in spark.read.schema("entreprise_id long, publication_id long").parquet(f"file://{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == {tuple(r) for r in want.collect()}
