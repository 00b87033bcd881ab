"""Changes of payloads over several micro-batches against a dict."""

import os
import random
from datetime import datetime, timedelta

from caseloom.streaming.events import changes

SCHEMA = "user_id bigint, event_type string, event_id bigint, ts timestamp, payload string"


def test_payloads_are_remembered_over_batches(spark, tmp_path):
    rnd, rows, want, last = random.Random(5), [], {}, {}
    for batch in range(3):
        some = [(rnd.choice([1, 2, None, 10 + batch]), rnd.choice("ab"), 100 * batch + i, rnd.choice([None, *[datetime(2024, 1, 1) + timedelta(hours=h) for h in range(4)]]), rnd.choice(["", "x"])) for i in range(40)]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{batch}")
        for f in (tmp_path / str(batch)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + batch, 1_700_000_000 + batch))
        for user, kind, event, ts, payload in sorted(some, key=lambda r: (r[3] is None, r[3] or 0, r[2])):
            old = last.get((user, kind))
            want[event] = "CREATED" if old is None else "UNCHANGED" if old == payload else "CHANGED"
            last[user, kind] = payload
        rows += some
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = [tuple(r) for r in changes(stream, "literal").collect()]
    assert dict(got) == want and len(got) == len(rows) == 120


def test_a_stream_without_files(spark, tmp_path):
    assert changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path)), "none").count() == 0
