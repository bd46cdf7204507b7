"""The post stream's keyed state: over batches, restarts and a second process."""

import json
import subprocess
import sys

from rentgrid.streaming.post_stream import start

ROOT = __file__.rsplit("/tests/", 1)[0]
SECOND = """
import sys
sys.path.insert(0, {root!r})
from rentgrid.session import get_spark
from rentgrid.streaming.post_stream import start
spark = get_spark("local[2]", shuffle_partitions=4)
start(spark, *sys.argv[1:4]).awaitTermination()
spark.stop()
"""


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"seq": s, "text": t, "extracted_at": at}) for s, t, at in rows]
    (folder / name).write_text("\n".join(lines))


def kept(spark, sink):
    return sorted((r.seq, r.batch) for r in spark.read.parquet(f"{sink}/posts").select("seq", "batch").collect())


def test_state_over_batches_and_processes(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    at = "2026-11-01T10:00:00"
    same = "x" * 100
    put(source, "a.json", [(5, "hot", at), (2, "hot", at), (3, same + "1", at), (4, same + "2", at), (9, "", at), (8, None, at)]
        + [(100 + i, "hot", at) for i in range(3000)] + [(1, "hot", "2026-11-01T11:00:00")])
    start(spark, str(source), sink, state).awaitTermination()
    assert kept(spark, sink) == [(2, 0), (3, 0)]
    put(source, "b.json", [(1, "hot", "2025-01-01T00:00:00"), (6, same, at), (7, "new", at)])
    start(spark, str(source), sink, state).awaitTermination()
    assert kept(spark, sink) == [(2, 0), (3, 0), (7, 1)]
    put(source, "c.json", [(11, "new", at), (12, "hot", at), (13, "third", at)])
    run = subprocess.run([sys.executable, "-c", SECOND.format(root=ROOT), str(source), sink, state], capture_output=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert kept(spark, sink) == [(2, 0), (3, 0), (7, 1), (13, 2)]
    assert not (tmp_path / "out" / "_keys").exists()
