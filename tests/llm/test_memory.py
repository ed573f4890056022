"""What a scan holds in a Python worker at once."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from colloquy.llm import secrets

WORDS = ["password", "=", "abcd1234", "AKIA", "ABCDEFGHIJKLMNOP", "token: ", "é", "plain ", "0123456789abcdef" * 2, "\n"]


class Frame:
    """Takes the function that a DataFrame would hand to its tasks."""

    schema = None

    def mapInArrow(self, scan, schema):  # noqa: N802
        return scan


@pytest.mark.parametrize("texts", [["clean words and more " * 200] * 1900, ["clean words and more " * 400_000]], ids=["many", "one long"])
def test_secret_scan_has_small_scratch_memory(texts):
    texts = [t.encode() for t in texts]
    scanner = secrets.Scanner()
    scanner.scan([b"warm"])
    tracemalloc.start()
    try:
        assert not any(scanner.scan(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    size = sum(map(len, texts))
    assert peak < 3 * size + 12e6  # the joined texts and a decoded one besides the blocks


def test_secret_scan_slices_batches_by_bytes():
    texts = ["x" * 300_000 + f" token={'k' * 9}"] * 20 + [None, ""]
    batch = pa.record_batch({"id": pa.array(range(22)), "text": pa.array(texts)})
    parts = list(secrets._scanned(Frame(), "text", secrets.RULES, "", masking=True)(iter([batch])))
    assert max(p.num_rows for p in parts[:6]) <= 4 and sum(p.num_rows for p in parts) == 22
    out = pa.Table.from_batches(parts)
    assert out.column("id").to_pylist() == list(range(22))
    assert out.column("text").to_pylist() == ["x" * 300_000 + " [secret:assign]"] * 20 + [None, ""]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_secrets_over_block_edges(monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block, raising=False)
    rng = random.Random(block)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for _ in range(80)] + ["", "ab"]
    want = [sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in r.compiled().finditer(t) if len(m[r.group]) >= r.least) for t in texts]
    assert [[(a, k, b) for a, b, k in x] for x in secrets.Scanner().scan([t.encode() for t in texts])] == want
    assert sum(map(bool, want)) > 20
