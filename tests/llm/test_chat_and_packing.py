"""Chat formatting round trips; packing is exact, gapless and near the bound."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest

from auditloom.llm import chat, packing

pytest.importorskip("public_tokenizers")
CONV = "conv_id bigint, turn bigint, role string, text string"


def test_escape_round_trip():
    r, bits = random.Random(2), ["<", "s", ">", "</s>", "[", "]", "INST", "/", "\\", "[INST]", "<\\s>", "é", "\n", "[\\\\OUT]", "[ROLE]"]
    code = chat.encoding(chat.byte_vocabulary())
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        role = r.choice(["user", "assistant", "system", "", "tool", "[/ROLE]"])
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
        ids, mask, formatted = chat.assemble(role, text, code.encode_ordinary)
        assert chat.read_back(ids, mask, code.decode_bytes) == (role, text, text if role == "assistant" else "")
        assert len(ids) == len(mask) and (ids[mask == 1] < chat.FIRST_RESERVED).all()


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (None, 0, None, "x"), (2, 0, "assistant", ""), (1, 3, "assistant", "c" * 70_000), (1, 3, "assistant", "c" * 70_000)]
    path = chat.byte_vocabulary()
    turns = chat.format_turns(spark.createDataFrame(rows, CONV).withColumn("input_ids", chat.F.lit(1)), path)
    got = {r.conv_id: r for r in chat.conversation_digests(turns, path).collect()}
    said = "user\n\nassistant\nb\n" + f"assistant\n{'c' * 70_000}\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_chars == 140_001 and got[1].loss_sha256 == hashlib.sha256(("b" + "c" * 140_000).encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    starts = [r.token_start for r in chat.with_token_starts(turns.filter("conv_id = 1")).orderBy("turn", "token_start").collect()]
    assert starts[0] == 0 and starts == sorted(starts) and len(set(starts)) == 4
    assert chat.conversation_digests(turns.limit(0), path).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_vocabulary())


def test_text_ids_are_the_tokenizers():
    r, t, ids = random.Random(1), tokenizer(), packing.text_ids(packing.public_vocabulary())
    plain = [*"aAbBzZéÉßñÑ .,\n\t0123!?-_|<>/ªº×µŉǅſ*%$", "...", "the ", "!!", "__", "1a", "<s>"]
    for bits in (plain, [*plain, *"'’“Σς漢字İ\u0301\u00a0\u0085\x1c²¼", "'s", "<|endoftext|>"]):
        for _ in range(3000):
            text = "".join(r.choice(bits) for _ in range(r.randint(0, 15)))
            assert np.frombuffer(ids(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_nnls():
    r = np.random.default_rng(0)
    a = r.random((6, 9))
    x = packing.nnls(a, a @ np.array([0, 2, 0, 0, 1, 0, 3, 0, 0.0]))
    assert (x >= 0).all() and np.allclose(a @ x, a @ np.array([0, 2, 0, 0, 1, 0, 3, 0, 0.0]), atol=1e-6)


def best_fit_decreasing(histogram, size):
    rooms, n = [], 0
    for length in sorted((x for x, k in histogram.items() for _ in range(k)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            n += 1
            bisect.insort(rooms, size - length)
        else:
            bisect.insort(rooms, rooms.pop(at) - length)
    return n


@pytest.mark.parametrize("size", [32, 256, 2048])
def test_plan_uses_every_piece_once(size):
    r = random.Random(size)
    for _ in range(4):
        histogram = {}
        for _ in range(r.choice([0, 3, 400, 4000])):
            length = min(size, max(1, int(r.lognormvariate(np.log(size / 5), 1))))
            histogram[length] = histogram.get(length, 0) + 1
        plan = packing.plan_packing(histogram, size)
        used = {}
        for content, n in plan:
            assert n > 0 and sum(x * m for x, m in content) <= size
            for x, m in content:
                used[x] = used.get(x, 0) + n * m
        assert used == histogram
        assert sum(n for _, n in plan) <= 1.02 * best_fit_decreasing(histogram, size) + 1


def test_other_vocabularies():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids, t = packing.TextIds(path), Tokenizer.from_file(path)
    for text in ("Some  Words, here.\n", " x", ""):
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_ranks_in_parts(spark):
    docs = spark.createDataFrame([(k % 50, "word " * (k % 7)) for k in range(400)] + [(900, "word " * 95)], "doc_id bigint, text string")
    pieces = packing.checkpoint(packing.tokenize_pieces(docs, packing.public_vocabulary(), size=32))
    out = packing.pack(pieces, 32, ranked_rows=9).collect()
    assert len(out) == pieces.count()
    taken = {(p.sequence_id, p.offset + k) for p in out for k in range(p.length)}
    assert len(taken) == sum(p.length for p in out) and max(at for _, at in taken) < 32
    assert all(p.offset == 0 for p in out if p.length == 32) and len({p.sequence_id for p in out if p.sequence_id < 0}) == sum(p.length == 32 for p in out) == 3


def test_pack_documents(spark):
    r, t = random.Random(3), tokenizer()
    docs = [(k, r.choice([None, "", "Some words, here. " * r.randint(1, 60), "x"])) for k in range(120)] + [(7, "again"), (None, "no id"), (500, "long text " * 2000)]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("length", packing.F.lit(0)), size=256).collect()
    by_sequence = {}
    for p in out:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    for doc_id, text in [(i, x) for i, x in docs if i in (500, None)]:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in out if p.doc_id == doc_id)
        assert mine == [(k // 1024, k // 4, len(ids[k : k + 1024]) // 4, zlib.crc32(ids[k : k + 1024])) for k in range(0, len(ids), 1024)]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
