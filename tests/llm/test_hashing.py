"""Range hashes: plain arithmetic, and texts that agree under any polynomial modulo a power of two."""

import hashlib

import numpy as np
import pytest

from lexcorpus.llm import cascade, hashing
from lexcorpus.llm.hashing import Hashed, Powers
from lexcorpus.llm.repeats import cut_repeats, digest
from lexcorpus.llm.sketches import near_duplicates


def thue_morse(size: int, letters: str) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(size))


ONE, OTHER = thue_morse(1024, "ab"), thue_morse(1024, "ba")


def plain(data: bytes) -> int:
    prime = (1 << 61) - 1
    raw = sum(int(hashing.BYTE_VALUE[c]) * pow(hashing._BASE, k, prime) for k, c in enumerate(data)) % prime
    word = raw ^ (len(data) * int(hashing._GOLDEN) % (1 << 64))
    return int(hashing.mix(np.array([word], np.uint64))[0])


def test_ranges_are_plain_polynomials_modulo_the_prime():
    dice = np.random.default_rng(1)
    data = dice.integers(0, 256, 3000).astype(np.uint8)
    data[1500:1700] = data[100:300]
    start = np.concatenate([[0, 0, 2999, 3000], dice.integers(0, 2900, 60)])
    end = np.concatenate([[0, 3000, 3000, 3000], start[4:] + dice.integers(0, 100, 60)])
    hashed = Hashed(data, Powers())
    assert hashed.ranges(start, end).tolist() == [plain(data[a:b].tobytes()) for a, b in zip(start, end)]
    place = np.arange(100, 200)
    assert (hashed.ranges(place, place + 100) == hashed.ranges(place + 1400, place + 1500)).all()
    edge = np.array([0, 1, (1 << 61) - 2, 1 << 60, (1 << 31) - 1, 1 << 31], np.uint64)
    assert hashing._times(edge[:, None], edge[None]).tolist() == [[a * b % ((1 << 61) - 1) for b in edge.tolist()] for a in edge.tolist()]


def test_thue_morse_texts_differ():
    data = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    first, second = Hashed(data, Powers()).ranges(np.array([0, 1024]), np.array([1024, 2048])).tolist()
    assert first != second


def test_thue_morse_texts_in_the_operators(spark):
    kind = "doc_id long, text string"
    rows = [(1, ONE), (2, OTHER), (3, f"{ONE}\n{OTHER}"), (4, f"{ONE}\n{ONE}\n{OTHER}")]
    docs = spark.createDataFrame(rows, kind)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs.where("doc_id < 3"), words=2).collect()} == {1: 1, 2: 2}
    judged = {r.doc_id: r.n_dup_lines for r in cascade.judge(docs).collect()}
    assert judged == {1: 0, 2: 0, 3: 0, 4: 1}
    # windows of 100 bytes by brute force: these words hold the factors of each other
    seen, want = set(), {}
    for doc, text in rows[:2]:
        cover, raw = set(), text.encode()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                cover.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        left = bytes(c for k, c in enumerate(raw) if k not in cover)
        want[doc] = (len(cover), hashlib.sha256(left).hexdigest())
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in digest(cut_repeats(docs.where("doc_id < 3"))).collect()}
    assert found == want


@pytest.mark.parametrize("equal", ["lines", "windows"])
def test_seemingly_equal_lines_and_windows_are_compared(monkeypatch, equal):
    """With a hash that sees lengths only, every count is still that of the bytes."""
    monkeypatch.setattr(Hashed, "ranges", lambda self, start, end: hashing.mix((end - start).astype(np.uint64)))
    words = " ".join(f"w{k:03d}" for k in range(60))
    text = "\n".join(["line 1", "line 2", "line 1", "", ""]) if equal == "lines" else f"{words} {words[:59]}"
    texts = cascade.Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), Powers())
    if equal == "lines":
        assert texts["n_dup_lines"].tolist() == [1]
    else:
        assert texts["n_repeat_words"].tolist() == [24]


