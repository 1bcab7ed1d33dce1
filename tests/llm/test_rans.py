"""Token files: round trips on the coder, and whole tables against the library."""

import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from answerlab.llm import rans

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("count", [1, 63, 64, 65, 16_385, rans.BLOCK, rans.BLOCK + 1, 2 * rans.BLOCK + 777])
def test_round_trip(count):
    random = np.random.default_rng(count)
    ids = np.minimum(random.zipf(1.3, count), 50_000).astype(np.uint32)
    coded = rans.encode_segment(ids)
    assert np.array_equal(rans.decode_segment(coded["symbols"], coded["freqs"], coded["blocks"], count), ids)
    if count > rans.BLOCK:
        assert len(coded["blocks"]) == -(-count // rans.BLOCK)
        assert sum(len(b["payload"]) for b in coded["blocks"]) < 2 * count


def test_one_symbol_only():
    coded = rans.encode_segment(np.full(1000, 7, np.uint32))
    assert rans.decode_segment(coded["symbols"], coded["freqs"], coded["blocks"], 1000).tolist() == [7] * 1000


def test_marks_decode_on_their_own():
    ids = np.random.default_rng(1).integers(0, 300, rans.BLOCK).astype(np.uint32)
    coded = rans.encode_segment(ids)
    block = coded["blocks"][0]
    assert [m["step"] for m in block["marks"]] == list(range(0, rans.STEPS, rans.MARK))
    half = block["marks"][2]
    part = {**block, "start": 0, "n": rans.BLOCK // 2, "marks": [{**half, "step": 0}]}
    rest = ids[rans.BLOCK // 2 :]
    part["crc32"] = zlib.crc32(rest.astype("<u4").tobytes())
    assert np.array_equal(rans.decode_segment(coded["symbols"], coded["freqs"], [part], len(rest)), rest)


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    coded = rans.encode_segment(ids)
    payload = bytearray(coded["blocks"][0]["payload"])
    payload[100] ^= 1
    coded["blocks"][0]["payload"] = bytes(payload)
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_segment(coded["symbols"], coded["freqs"], coded["blocks"], 5000)


def expected(rows):
    library = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 2]
        out.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [rans.SEGMENT, 300])
def test_table(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(rans, "SEGMENT", segment)
    odd = ["I'll  two\t\n three ", "　x y\u2003z ", "\x85a", "tail \n", "<|endoftext|>x"]
    rows = cases.documents() + [(100 + i, text, "en", "s", 1) for i, text in enumerate(odd)]
    path = str(tmp_path / "ids")
    rans.write_ids(cases.frame(spark, rows), path, VOCABULARY, end_id=2)
    assert cases.rows_of(rans.read_ids(spark, path, with_ids=True)) == expected(rows)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    rans.write_ids(cases.frame(spark, []), path, VOCABULARY, end_id=2)
    assert rans.read_ids(spark, path).collect() == []


def test_texts_to_encode_whole_are_found():
    encoder = rans.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in encoder.library.get_added_tokens_decoder().values()]
    parts = ["a", "é", "\x1b", "\x1c", "\x1f", "\x85", "\xa0", " ", "ᚁ", " ", "​", " ", " ", "　", "<|", *special]
    random = np.random.default_rng(5)
    for size in (0, 1, 2, 40, 400):
        for _ in range(60):
            data = "".join(random.choice(parts, size)).encode()
            found = encoder.odd_places(np.frombuffer(data, np.uint8))
            assert set(found) >= {m.start() for m in encoder.odd.finditer(data)}
            assert all(encoder.odd.match(data, place) for place in found)


@pytest.mark.parametrize("most", [50_000, rans.TABLE, 1 << 32])
def test_ids_below_and_beyond_the_table(most):
    ids = np.random.default_rng(6).choice(np.array([0, 7, most // 2, most - 1], np.uint32), 3 * rans.BLOCK // 2)
    row = rans.encode_segment(ids)
    assert (rans.decode_segment(row["symbols"], row["freqs"], row["blocks"], len(ids)) == ids).all()
