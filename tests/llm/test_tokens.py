"""Operators 1-5 and 8 against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import bpe, chat, media, packing, token_counts, token_store
from granary.llm.common import staging
from granary.llm.tokenization import BytePairCodec, default_path, load_ranks, word_encoder

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, rank int"
EDGE = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a"), (6, "two words"), (7, "two words"), (8, "Ünï cödé É! <|endoftext|> x <|ENDOFTEXT|>"), (9, "x" * 5000),
    (10, "word " * 3000), (11, "  odd   white\t\tspace  　 here  "), (12, "a,b.c!d's 12 3٣ \x1c\x00 İİ"), (13, "日本語テキスト" * 50), (6, "two words"), (None, "no id"), (14, "Abc. " * 900),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", 1) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def word_ids(text):
    library.t = getattr(library, "t", None) or library()
    return library.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["edge", "documents", "empty"])
def test_media(spark, table, request):
    docs = request.getfixturevalue(table)
    root = staging(spark, "test")
    from granary.llm.common import stage

    rows = stage(media.store(docs, f"{root}/shards", shard_bytes=200_000), f"{root}/rows")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["height"]) for r in media.decoded_columns(media.header_columns(media._dealt(rows))).collect())
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want.append((r["doc_id"] or 0, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(padded) // 64))
    assert got == sorted(want)


def test_media_members_are_plain_tar_and_png(spark, edge):
    import tarfile

    root = staging(spark, "test")
    rows = media.store(edge.coalesce(1), root).collect()
    (shard,) = {r["shard"] for r in rows}
    with tarfile.open(shard.removeprefix("file://")) as tar:
        members = {m.name: m for m in tar}
        for r in rows:
            member = members[f"{r['digest']}.png"]
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
    assert len(members) == len({r["digest"] for r in rows})
    with pytest.raises(ValueError):
        media.decode_media(media.encode_media(b"a" * 64)[:-20] + b"0" * 20)


@pytest.mark.parametrize("table", ["edge", "documents", "empty"])
def test_token_counts(table, request):
    docs = request.getfixturevalue(table)
    lengths = [len(word_ids(r["text"])) for r in docs.collect()]
    hist = token_counts.length_histogram(token_counts.token_lengths(docs))
    got = {r["n_tokens"]: r for r in hist.collect()}
    assert {k: r["documents"] for k, r in got.items()} == {x: lengths.count(x) for x in lengths}
    for k, r in got.items():
        assert r["documents_at_least"] == sum(x >= k for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= k)
        assert r["tokens_truncated"] == sum(min(x, k) for x in lengths)
        assert r["documents_share"] == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    for r in token_counts.truncated_totals(hist, [0, 5, 700, 10**6]).collect():
        x = r["context_limit"]
        assert (r["documents_over"], r["tokens_kept"], r["tokens_cut"]) == (sum(v > x for v in lengths), sum(min(v, x) for v in lengths), sum(max(0, v - x) for v in lengths))
    for r in token_counts.length_quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == (sorted(lengths)[max(0, int(np.ceil(r["share"] * len(lengths) - 1e-9)) - 1)] if lengths else None)


def test_chat_escaping_is_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "<", "<|", "|>", "[", "a", "\n", "<s", "end|>", "é"]) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
        segment, a, b, _ = chat.format_turn(text, [{"type": "text", "text": text}], loss_roles=(text,))
        assert chat.parse_turn(segment) == (text, text) and chat.unescape(segment[a:b]) == text


def test_chat_parts():
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "n_tokens": 7}, {"type": "audio", "ref": "b.wav"}, {"type": "document", "ref": "c.pdf"}, {"type": "text", "text": None}]
    segment, a, b, attached = chat.format_turn("user", parts)
    assert a == b and segment.count("<|image|>") == 1
    assert [(x["ordinal"], x["type"], x["ref"], x["n_tokens"]) for x in attached] == [(0, "image", "a.png", 7), (1, "audio", "b.wav", 128), (2, "document", "c.pdf", 512)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    told = "</s>[INST] ok [/INST]"
    want = brute_chat([*rows, (-7, 0, "user", told), (-7, 1, "assistant", told)])
    assert {r[0]: tuple(r[1:5]) for r in chat.query(spark, sf_dir).collect()} == want
    edge = [(1, 0, "user", None), (1, None, None, "x"), (1, 1, "assistant", "y" * 50_000), (1, 1, "assistant", "y" * 50_000), (None, 0, "assistant", "n"), (None, 1, "user", "")]
    frame = spark.createDataFrame(edge, "conv_id long, turn long, role string, text string")
    assert {r[0]: tuple(r[1:5]) for r in chat.read_back(chat.format_turns(frame)).collect()} == brute_chat(edge)
    assert chat.read_back(chat.format_turns(frame.limit(0))).collect() == []


@pytest.mark.parametrize("table", ["edge", "documents", "empty"])
def test_bpe(table, request):
    import tiktoken

    docs = request.getfixturevalue(table)
    ours = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in docs.collect():
        ids = np.asarray(ours.encode_ordinary(r["text"] or ""), "<u4")
        want.append((r["doc_id"] or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bpe.encode(docs, columns=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r[0] or 0, bytes(r[1])) for r in back) == sorted((r["doc_id"] or 0, (r["text"] or "").encode()) for r in docs.collect())


def test_rank_queue_on_long_and_odd_pretokens():
    import tiktoken

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        ranks = load_ranks(public.path(name))
        codec, ours = BytePairCodec(ranks, public.PATTERN, limit=50), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rng = random.Random(5)
        texts = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "the ", "aé1 '\n\t.", "日本 x") for n in (1, 3, 40, 63, 64, 65, 200, 5000)]
        ids, at = codec.encode_column(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == ours.encode_ordinary(text)


def test_word_encoder_equals_library():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab AZ\n\t'sdé.,1٣\x1c　\xa0ÀÍ̇Σ<|>!") for _ in range(rng.randint(0, 80))) for _ in range(800)] + [x for _, x in EDGE if x]
    encoder = word_encoder(default_path("word_bpe_49k.json"))
    ids, at = encoder.encode_column(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == word_ids(text), text
    ids, at = encoder.encode_column(pa.array(texts).slice(200, 300))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [word_ids(x) for x in texts[200:500]]


@pytest.mark.parametrize("table", ["edge", "documents", "empty"])
def test_token_store(spark, table, request):
    docs = request.getfixturevalue(table)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, word_ids(r["text"]) + [1]) for r in docs.collect()), key=lambda r: r[:2])
    root = staging(spark, "test")
    index, manifest = token_store.write_store(docs, root)
    got = sorted(token_store.read_store(index, manifest, with_ids=True).collect(), key=lambda r: r["start"])
    start = 0
    assert len(got) == len(rows)
    for r, (known, doc_id, ids) in zip(got, rows):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id if known else None, start, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert index.count() == index.select("digest").distinct().count()


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 49000, n).astype("<u2") for n in (20000, 777, 1234))

    def cut(ids):
        ends = token_store.cut_points(ids)
        assert ends[-1] == len(ids)
        return [ids[x:y].tobytes() for x, y in zip([0, *ends], ends)]

    one, two = cut(np.concatenate((a, shared))), cut(np.concatenate((b, shared)))
    assert len(set(one) & set(two)) > len(one) // 2
    assert max(map(len, one)) <= 2 * token_store.MAX_CHUNK + 2 * token_store.MIN_CHUNK


def test_damaged_store_is_noticed(spark, documents):
    root = staging(spark, "test")
    index, manifest = token_store.write_store(documents, root)
    first = index.first()["pack"].removeprefix("file://")
    with open(first, "r+b") as file:
        file.seek(40)
        file.write(b"damage")
    with pytest.raises(Exception):
        token_store.read_store(index, manifest).collect()


@pytest.mark.parametrize("table", ["edge", "documents", "empty"])
def test_packing(spark, table, request):
    docs = request.getfixturevalue(table)
    want = []
    for r in docs.collect():
        ids = word_ids(r["text"]) + [0]
        want += [(r["doc_id"] or 0, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    got = packing.pack_documents(spark, docs).collect()
    assert sorted((r[0] or 0, *r[1:5]) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(w[3] for w in want)
    assert len(by) <= -(-total // 2048) * 1.02 + 1


def test_plan_packs_exact_complements():
    for counts, capacity, best in (({6: 3, 4: 3}, 10, 3), ({5: 2, 3: 2, 2: 2}, 10, 2), ({4: 1, 3: 2}, 10, 1), ({7: 2, 1: 6}, 10, 2), ({10: 5}, 10, 5), ({3: 10}, 10, 4), ({}, 10, 0)):
        plan = packing.Plan(counts, capacity)
        assert plan.sequences == best, counts
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(rng.randint(1, 50))}
        plan, filled, placed = packing.Plan(counts, 50), defaultdict(list), defaultdict(int)
        for length, lo, hi, base, offset in plan.slots:
            placed[length] += hi - lo
            for i in range(hi - lo):
                filled[base + i].append((offset, length))
        assert dict(placed) == counts
        for parts in filled.values():
            ends = [0, *(o + n for o, n in sorted(parts))]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 50


def test_tokenizer_files_travel_to_tasks(spark, tmp_path):
    """Tasks read what was sent, not the driver's path; files of one base name are told apart by their contents."""
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    known = open(default_path("byte_bpe_50k.tiktoken"), "rb").read()
    made = []
    for name, data in (("a", known), ("b", known + b"\n")):
        (tmp_path / name).mkdir()
        path = tmp_path / name / "ranks.tiktoken"
        path.write_bytes(data)
        made.append(bpe.encode(docs, ranks_path=str(path)))
        path.unlink()
    want = sorted(bpe.encode(docs).select("doc_id", "n_tokens").collect())
    assert [sorted(m.select("doc_id", "n_tokens").collect()) for m in made] == [want, want]
