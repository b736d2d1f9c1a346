import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm.token_store import EliasFano, Encoder, Shard, default_vocabulary, read_manifest, read_tokens, write_tokens


@given(st.lists(st.integers(0, 10_000), max_size=700), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values, beyond):
    values = sorted(values)
    universe = (values[-1] if values else 0) + beyond
    packed = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64), universe).to_bytes())
    assert packed.decode().tolist() == values
    assert [packed.select(i) for i in range(0, len(values), 13)] == values[::13]


def test_elias_fano_is_near_minimal():
    values = np.sort(np.random.default_rng(3).integers(0, 10**7, 50_000))
    packed = EliasFano.encode(values, 10**7).to_bytes()
    # 2 + log2(universe / n) bits, and the samples of select.
    assert 8 * len(packed) / len(values) < 2 + np.log2(10**7 / 50_000) + 0.5
    with pytest.raises(IndexError):
        EliasFano.from_bytes(packed).select(50_000)


@given(st.lists(st.text("ab .,!'\n\t\x01é  1<|>", max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library(texts):
    import pyarrow as pa

    encoder = _encoder()
    data, counts = encoder.encode_array(pa.array([*texts, "x <|endoftext|> y", None], pa.string()))
    ids = np.split(np.frombuffer(data, "<u2"), np.cumsum(counts)[:-1])
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "x <|endoftext|> y", ""]]
    assert [x.tolist() for x in ids] == expected


def _encoder(made=[]):  # noqa: B006
    if not made:
        made.append(Encoder(default_vocabulary(), 2))
    return made[0]


def test_memory_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("freshet.llm.token_store._MOST_KEPT", 50)
    encoder = Encoder(default_vocabulary(), 4)
    for k in range(4):
        data, _ = encoder.encode_array(pa.array([f"word{k}x{i} and" for i in range(60)]))
        assert np.frombuffer(data, "<u4").tolist() == [t for i in range(60) for t in encoder.tokenizer.encode(f"word{k}x{i} and").ids]
    assert len(encoder.kept) < 200


def test_ids_some_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("freshet.llm.token_store._LEARN_PIECES", 2)
    monkeypatch.setattr("freshet.llm.token_store._GATHER_PIECES", 3)
    encoder = Encoder(default_vocabulary(), 2)
    texts = ["two  blanks ", "word word, word. wörd! 1st, 2nd; a.b ,", "", "x <|endoftext|> y", "no break", " \n ", "end, of it.\nword."]
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # New pieces, then remembered ones; a slice's offsets don't begin at 0.
    for _ in range(2):
        data, counts = encoder.encode_array(pa.array(["left out", *texts]).slice(1))
        assert [x.tolist() for x in np.split(np.frombuffer(data, "<u2"), np.cumsum(counts)[:-1])] == expected
        assert encoder.count_array(pa.array([*texts, None])).tolist() == [*map(len, expected), 0]
    # A core is remembered once, whatever sign follows it.
    assert len(set(encoder.kept.to_pylist())) == len(encoder.kept) and " word," not in encoder.kept.to_pylist()


_MEASURED = """
import random
import pyarrow as pa
import tokenizers, pyarrow.compute
from freshet.llm.token_store import Encoder, default_vocabulary

def kilobytes(field):
    return int(next(line for line in open("/proc/self/status") if line.startswith(field)).split()[1])

draw = random.Random(1)
texts = pa.array([" ".join("".join(draw.choices("abcdefghijklmnop", k=9)) + draw.choice(["", ",", "."]) for _ in range(500)) for _ in range(400)])
before = kilobytes("VmRSS")
encoder = Encoder.of(default_vocabulary())
encoder.encode_array(texts)
print((kilobytes("VmHWM") - before) // 1024)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads the process's memory from /proc")
def test_memory_of_a_worker():
    """The vocabulary is loaded once, and 200,000 new pieces don't all lie in memory as the library's objects."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", _MEASURED], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) < 150


def test_store(spark, table, hard_rows, tmp_path):
    docs = table(hard_rows)
    manifest = write_tokens(docs, str(tmp_path / "store"), default_vocabulary(), docs_per_shard=3)
    rows = sorted(read_tokens(spark, str(tmp_path / "store")).collect(), key=lambda r: r.start)
    assert len(rows) == len(hard_rows)
    keys = [r.key for r in rows]
    assert keys == [None, None, *sorted(k for k, *_ in hard_rows if k is not None)]
    encode = _encoder().tokenizer.encode
    expected = sorted((-1 if k is None else k, tuple([*encode(t or "", add_special_tokens=False).ids, 0])) for k, t, *_ in hard_rows)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((-1 if r.key is None else r.key, r.n_tokens, r.ids_crc32) for r in rows) == sorted((k, len(i), crc(i)) for k, i in expected)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    # Random access: select finds every document of every shard.
    for m in manifest.collect():
        shard = Shard(m.path)
        for i, key in enumerate(shard.keys()):
            ids = shard.ids(i)
            assert ids[-1] == 0 and crc(ids) in {r.ids_crc32 for r in rows if r.key == key}
        shard.close()
    assert not list((tmp_path / "store" / "_temporary").iterdir())


def test_empty(spark, table, tmp_path):
    write_tokens(table([]), str(tmp_path / "none"), default_vocabulary())
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert read_manifest(spark, str(tmp_path / "none")).count() == 0
