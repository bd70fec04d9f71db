"""Flat token files and zstandard lines: exact round trips, byte ranges, commits."""

import json
import os
import random

import numpy as np
import pytest
import zstandard

from quillspark.sources import token_files as TF
from quillspark.sources.scans import scan_compressed_glob


def _chunks(spark, chunk=16):
    rng = random.Random(1)
    streams = {("a", "train"): 1000, ("a", "val"): 37, (None, "train"): 16, ("b", "train"): 1}
    ids = {k: [rng.randrange(65536) for _ in range(n)] for k, n in streams.items()}
    rows = [(*k, i // chunk, v[i:i + chunk]) for k, v in ids.items() for i in range(0, len(v), chunk)]
    rng.shuffle(rows)
    return {f"dataset={d}/split={s}" if d else f"dataset/split={s}": v for (d, s), v in ids.items()}, \
        spark.createDataFrame(rows, "dataset string, split string, chunk_id bigint, tokens array<int>").repartition(3)


def test_round_trip_equals_the_chunk_table(spark, tmp_path):
    want, chunks = _chunks(spark)
    path = TF.write_token_files(chunks, str(tmp_path / "t"), chunk_size=16)
    assert os.path.exists(f"{path}/_SUCCESS") and not os.listdir(f"{path}/_temporary")
    # nothing but ids in the files
    for stream, ids in want.items():
        parts = sorted(os.listdir(f"{path}/{stream}"))
        assert np.concatenate([np.fromfile(f"{path}/{stream}/{p}", "<u2") for p in parts]).tolist() == ids
    for chunk, split in ((16, 48), (7, 14), (5000, 10)):
        got: dict = {}
        for r in sorted(TF.read_token_files(spark, path, chunk, split=split).collect(), key=lambda r: (r["chunk_id"], r["at"])):
            s = got.setdefault(r["stream"], [])
            assert len(s) == r["chunk_id"] * chunk + r["at"] and r["at"] + len(r["tokens"]) <= chunk
            s += r["tokens"]
        assert got == want
    # written again, the files of before are gone
    TF.write_token_files(chunks.filter("split = 'val'"), path, chunk_size=16)
    assert {r["stream"] for r in TF.read_token_files(spark, path, 16).collect()} == {"dataset=a/split=val"}


def test_windows_read_only_their_bytes(spark, tmp_path):
    want, chunks = _chunks(spark)
    path = TF.write_token_files(chunks, str(tmp_path / "t"), chunk_size=16)
    rng = random.Random(2)
    rows = [(s, f"{s}:{i}", rng.randrange(len(v) + 3)) for s, v in want.items() for i in range(20)] + [("none", "x", 0)]
    got = TF.read_windows(spark.createDataFrame(rows, "stream string, wid string, start bigint"), path, 33).collect()
    assert len(got) == len(rows)
    assert all(r["tokens"] == want.get(r["stream"], [])[r["start"]:r["start"] + 33] for r in got)


def test_a_file_of_another_tool_and_wide_ids(spark, tmp_path):
    ids = np.arange(70_000, dtype="<u4")
    ids.tofile(tmp_path / "train.bin")
    df = TF.read_token_files(spark, str(tmp_path / "train.bin"), 1000, width=4, split=5000)
    assert df.rdd.getNumPartitions() == 14
    rows = sorted(df.collect(), key=lambda r: r["chunk_id"])
    assert [x for r in rows for x in r["tokens"]] == ids.tolist() and {r["stream"] for r in rows} == {"train"}


def test_an_id_too_large_fails_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "train", 0, [1, 70_000])], "dataset string, split string, chunk_id bigint, tokens array<int>")
    with pytest.raises(Exception, match="does not fit"):
        TF.write_token_files(df, path)
    assert not os.path.exists(f"{path}/_SUCCESS") and TF.list_parts(path, 2) == []


def test_zst_and_gz_alike(spark, tmp_path):
    rows = [{"dataset": "d", "pos": i, "text": "é " * (i % 50)} for i in range(3000)]
    lines = [json.dumps(r, ensure_ascii=False).encode() + b"\n" for r in rows]
    data = b"".join(lines[:1500]) + b"\n  \n" + b"".join(lines[1500:])
    half = len(b"".join(lines[:700]))
    c = zstandard.ZstdCompressor()
    (tmp_path / "a.jsonl.zst").write_bytes(c.compress(data[:half]) + c.compress(data[half:]))  # two frames
    (tmp_path / "b.jsonl.zst").write_bytes(c.compress(b'{"dataset": "e", "pos": 1, "text": null}'))
    import gzip
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(data))
    schema = "dataset string, pos bigint, text string"
    zst = scan_compressed_glob(spark, f"{tmp_path}/*.jsonl.zst", schema).collect()
    gz = scan_compressed_glob(spark, f"{tmp_path}/*.jsonl.gz", schema).collect()
    assert sorted(r["pos"] for r in gz) == list(range(3000))
    key = lambda r: (r["dataset"], r["pos"])
    assert sorted((r for r in zst if r["dataset"] == "d"), key=key) == sorted(gz, key=key)
    assert [tuple(r) for r in zst if r["dataset"] == "e"] == [("e", 1, None)]
    (tmp_path / "c.jsonl.zst").write_bytes(c.compress(b'{"dataset": '))
    with pytest.raises(Exception):  # noqa: B017
        scan_compressed_glob(spark, f"{tmp_path}/c.jsonl.zst", schema).collect()


def test_config_files(spark, tmp_path):
    from quillspark.sources.scans import config_from_file, config_sources
    (tmp_path / "c.yaml").write_text("datasets:\n  web:\n    name: org/web\n    subset: en\n    target_tokens: 5000\n  code: {name: org/code}\nother: 1\n")
    (tmp_path / "c.json").write_text('{"datasets": {"web": {"name": "org/web", "subset": "en", "target_tokens": 5000}, "code": {"name": "org/code"}}}')
    (tmp_path / "none.json").write_text("{}")
    a, b = (sorted(map(str, config_sources(spark, config_from_file(spark, str(tmp_path / f))).collect())) for f in ("c.yaml", "c.json"))
    assert a == b and len(a) == 2 and "target_tokens=5000" in "".join(a)
    assert config_from_file(spark, str(tmp_path / "none.json")) == {}
