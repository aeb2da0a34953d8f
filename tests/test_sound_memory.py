"""Sound is held a few clips at a time, however many there are."""

import numpy as np
import pyarrow as pa
import pytest

from lakesift.operators import quality
from lakesift.plans import audio_queries
from lakesift.sources import audio


@pytest.mark.parametrize("name", ["f11_mfcc", "f10_pcm_md5", "d1_sounds", "f9_batch_summary", "f8_inspect", "p2_passing", "s4_decode"])
def test_sound_stays_in_one_worker(spark, sf_dir, name):
    """Made, decoded and measured in one Python step: between two of them the JVM gathers sound into batches of 10,000 clips."""
    assert audio_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_few_clips_at_a_time(monkeypatch):
    made, encode = [], audio.encode_wav
    monkeypatch.setattr(audio, "encode_wav", lambda *a: made.append(1) or encode(*a))
    vectors = pa.array(np.random.default_rng(1).normal(0, 0.1, (500, 64)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500) * 50, pa.int64()), vectors], ["id", "embedding"])
    step = audio.chain(audio_queries._make, audio.decoding(audio_queries.SR), quality.measuring(embed=False, more=("load_error",)))
    found = step(iter([batch]))
    first = next(found)
    assert len(made) == first.num_rows == audio.CLIPS
    rows = [first, *found]
    assert max(x.num_rows for x in rows) == audio.CLIPS and pa.Table.from_batches(rows)["id"].to_pylist() == batch["id"].to_pylist()


def test_slices_are_measured_as_their_own():
    """A slice of a batch has its own clips, an empty one among them."""
    sounds = [np.full(k % 3 * 4000, 0.01 * k, np.float32) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), audio.lists(sounds), pa.array([8000] * 40, pa.int32())], ["id", "samples", "sr"])
    got = pa.Table.from_batches(quality.measuring()(iter([batch]))).to_pylist()
    assert [(r["id"], r["duration_sec"], r["md5"]) for r in got] == [(k, len(x) / 8000, quality.dsp.pcm_md5(x)) for k, x in enumerate(sounds)]


def test_clips_are_written_a_few_at_a_time(tmp_path):
    sounds = [np.full(100 + k, 0.01, np.float32) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), audio.lists(sounds), pa.array([8000] * 50, pa.int32())], ["id", "samples", "sr"])
    found = audio.writing(str(tmp_path))(iter([batch]))
    first = next(found)
    assert first.num_rows == audio.CLIPS == len(list(tmp_path.iterdir()))
    paths = pa.Table.from_batches([first, *found])["path"].to_pylist()
    assert [len(audio.decode_wav(open(p, "rb").read())[0]) for p in paths] == [len(x) for x in sounds]


def test_files_are_measured_in_one_worker(spark):
    """What curation of files and a19 do: the same table as by two steps, without samples in between."""
    wav = audio.encode_wav(np.arange(9000) % 700 * 20, 8000)
    files = spark.createDataFrame([(k, None if k == 3 else wav[: 44 + 400 * k * (k != 5)] if k else b"x") for k in range(8)], "id int, content binary")
    got = quality.measure_files(files, 8000)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    both = [sorted(map(repr, x.collect())) for x in (got, quality.measure(audio.decode(files, 8000)))]
    assert both[0] == both[1] and len(both[0]) == 8
