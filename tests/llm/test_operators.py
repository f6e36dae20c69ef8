"""Each operator against a plain version of its contract, on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from undula.llm import components as components_
from undula.llm import bpe, langid, lines, media, packing, quality, queries, simhash, substring, toxicity, urls
from undula.llm.components import components, forest

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def awkward(rnd: random.Random, n: int = 60) -> list[tuple]:
    """Rows of (doc_id, text): shared passages, repeats within a text, repeated rows, one id with two texts."""
    passages = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(15, 60))) for _ in range(8)]
    rows = [(None, passages[0]), (None, "x " + passages[0]), (1, None), (2, ""), (3, "a " * 50), (4, "a " * 30 + "b"), (5, " \t\n\x0b "), (6, "é\x85ü 日本 " * 30), (7, "long " * 20_000)]
    for i in range(8, n):
        parts = [rnd.choice([rnd.choice(passages), " ".join(f"{rnd.randint(0, 999):x}" for _ in range(rnd.randint(1, 30))), "\n\t"]) for _ in range(rnd.randint(0, 7))]
        rows.append((i, " ".join(parts)))
    return [*rows, rows[10], rows[20], (30, rows[40][1])]


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that clash with names used inside the operators."""
    more = {c: F.lit("x") for c in ("grp", "row", "fp", "key", "lang", "trusted", "score", "n", "kept")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(more).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def key(i):
    return (i is not None, i or 0)


# 1 ----------------------------------------------------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(1)
    plain = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rnd.randint(1, 4)))
    bad = ["vile", "rotten", "grimscum", "zorgfoul"]
    text = lambda x: " ".join(rnd.choice(bad) if x and rnd.random() < 0.06 else plain() for _ in range(120))
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.fit([t for i, t, x in rows if x and i % 2], [t for i, t, x in rows if not x and i % 2])
    df = spark.createDataFrame([*[(i, t) for i, t, _ in rows], (None, None), (7, "")], "doc_id long, text string")
    got = toxicity.score(df, model).toPandas()
    assert len(got) == 602 and got.score.between(0, 1).all()
    score = got.dropna().drop_duplicates("doc_id").set_index("doc_id").score
    held = [(i, x) for i, _, x in rows if not i % 2]
    assert np.mean([score[i] >= 0.7 for i, x in held if x]) > 0.8
    assert np.mean([score[i] >= 0.7 for i, x in held if not x]) < 0.02
    assert toxicity.fit([], ["a"]).score(["a"]) == 0.0


def test_toxicity_query(spark, none):
    got = queries.op1_toxicity(spark, SF).toPandas()
    assert len(got) == 200 and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


# 2 ----------------------------------------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 50), st.integers(1, 20))
def test_media_round_trip(payload, chunk, sync):
    content = media.write_audio(payload, chunk=chunk, sync=sync)
    (track,), error = media.read_tracks(content)
    assert error is None and media.read_payload(content, track) == payload
    assert (track.codec, track.handler, track.n_samples, track.duration, track.timescale) == ("raw ", "soun", len(payload), len(payload), media.RATE)
    assert [(s, content[at : at + n]) for s, at, n, _ in track.keyframes] == [(s, payload[s : s + 1]) for s in range(0, len(payload), sync)]


def test_media_of_other_layouts():
    box = media.box
    stz2 = box(b"stz2", struct.pack(">IB3xB", 0, 0, 0)[:4], struct.pack(">BBBBI", 0, 0, 0, 4, 3), bytes([0x12, 0x30]))
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), struct.pack(">I4s", 8, b"abcd")), box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2, 1)), stz2, box(b"co64", struct.pack(">IIQQ", 0, 2, 100, 200)))
    (track,), error = media.read_tracks(struct.pack(">I4sQ", 1, b"moov", 16 + len(box(b"trak", stbl))) + box(b"trak", stbl))
    assert error is None and track.runs == [(100, 3), (200, 3)] and track.n_samples == 3
    # without a table of sync samples every sample is a keyframe with its own range; samples of one size are one entry a chunk
    assert track.keyframes == [(0, 100, 1, 1), (1, 101, 2, 1), (2, 200, 3, 1)] and track.n_keyframes == 3
    even = media.box(b"stbl", box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2, 1)), box(b"stsz", struct.pack(">III", 0, 4, 3)), box(b"stco", struct.pack(">IIII", 0, 2, 100, 200)))
    (track,), _ = media.read_tracks(box(b"moov", box(b"trak", even)))
    assert track.keyframes == [(0, 100, 4, 2), (2, 200, 4, 1)] and track.n_keyframes == 3
    tkhd = box(b"tkhd", struct.pack(">IIII", 0, 0, 0, 9))
    moof = box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">III", 0x20, 9, 0x10000)), box(b"trun", struct.pack(">IIiIIIII", 0x305, 2, 64, 0, 5, 7, 5, 8))))
    content = box(b"moov", box(b"trak", tkhd)) + moof
    (track,), error = media.read_tracks(content)
    start = len(content) - len(moof) + 64
    assert error is None and track.keyframes == [(0, start, 7, 1)] and track.runs == [(start, 15)] and track.duration == 10
    assert media.read_tracks(b"\0\0\0\x04free")[1] and media.read_tracks(b"") == ([], None)


def test_media_query(spark, docs, rows):
    got = Counter(tuple(r)[:6] for r in media.text_media(docs).collect())
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        p = data + bytes(-len(data) % 64 if data else 64)
        m = media.write_audio(p)
        want[i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m)] += 1
    assert got == want
    probed = media.probe(spark.createDataFrame([(1, bytearray(media.write_audio(b"abc"))), (2, None), (3, bytearray(b"xxxxxxxxxxxx"))], "id int, content binary")).orderBy("id").collect()
    assert probed[0].tracks[0].codec == "raw " and probed[1].tracks == [] and probed[2].media_error


# 3 ----------------------------------------------------------------------------------------------------------------------------------------------------------


def plain_substrings(rows, window):
    first = {}
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            first[x] = min(first.get(x, (key(i), s)), (key(i), s))
    out = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key(i), s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_substrings(docs, rows, crowded, monkeypatch):
    whole = substring.removals
    monkeypatch.setattr(substring, "removals", lambda *a: whole(*a[:4], crowded=crowded))
    assert Counter(tuple(r) for r in substring.word_digests(docs).collect()) == plain_substrings(rows, 20)


def test_substring_texts(spark, none):
    p = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, p, "a"), (2, f"start\n here {p} and\n  end", "b"), (3, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in substring.without_repeats(df, "lang").collect()}
    assert got[1].text == p and got[2].text == "start\n here and\n  end" and got[2].lang == "b" and got[2].n_removed == 25
    assert substring.word_digests(none).count() == 0


# 4 ----------------------------------------------------------------------------------------------------------------------------------------------------------


def test_language_query(spark, none):
    got = queries.op4_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.accepted.mean() > 0.97
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ## 4"), (4, "xqzj kvwp zzxq jjqk vvwx qqzk xkcd zqx jxq " * 30), (None, "der und die nicht")], "doc_id long, text string")
    r = {x.doc_id: x for x in langid.identify(odd, model).collect()}
    assert [r[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and r[4].lang_pred != "und" and not r[4].accepted and r[None].lang_pred == "de"
    assert langid.identify(odd, langid.train(none)).filter("lang_pred = 'und' and score = 0").count() == 5


def test_language_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"{w} {w} {i}", w) for i, w in enumerate(["aba", "xyz"] * 4)], "doc_id long, text string, lang string")
    extra = docs.select("*", *(F.lit("x").alias(c) for c in ("lang_pred", "score", "cross_entropy", "accepted", "n", "gram")))
    found = [langid.identify(d, langid.train(d)).orderBy("doc_id").collect() for d in (docs, extra)]
    assert found[0] == found[1] and [r.lang_pred for r in found[0]] == ["aba", "xyz"] * 4


def test_kneser_ney_is_a_distribution():
    key, _, _ = langid.symbols(["abracadabra banana", "cabana bandana"])
    k, n = np.unique(key, return_counts=True)
    model = langid.fit([("x", k, n)])
    alphabet = sorted({int(g) & 0xFFFF for g in k})
    for context in {int(g) >> 16 for g in k[:10]} | {12345 << 32 | 97 << 16 | 98}:
        grams = np.array([context << 16 | c for c in alphabet], dtype=np.uint64)
        total = np.exp(model.score(grams)).sum()
        assert 0.9 < total <= 1 + 1e-5


# 5 and the tokenizers ---------------------------------------------------------------------------------------------------------------------------------------

ODD = ["", "  ", "a  b", "a   b ", "x\n\n  y", "\t \n z", "it's we'll  ", "a\u2003b\u00a0c\u0085d", "ΑΣ ΣΑΣ. É é İstanbul", "<|endoftext|> a <|startoftext|>", "日本語のテキスト。" * 80, "ab" * 1500, "thetionandthe" * 300 + " x", "é" * 700, "a\x1cb \x1d c", "a\0b \0 c", " lead", "a\n b\n  c"]


@pytest.mark.parametrize(("path", "kind"), [(WORD_BPE, bpe.Encoder), (BYTE_BPE, bpe.ByteEncoder)])
def test_encoders_equal_the_library(path, kind):
    enc = bpe.encoder(path, kind)
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("abcdefghij") for _ in range(3000))] + ["".join(rnd.choice("ab c'sé\n\t .1日") for _ in range(60)) for _ in range(200)]
    for t in texts:
        ids = enc.tokenizer.encode(t, add_special_tokens=False).ids
        want = struct.pack(f"<{len(ids)}I", *ids)
        if kind is bpe.Encoder:
            assert enc.encode_words(t) == (want, enc.tokenizer.decode(ids, skip_special_tokens=False)), t[:80]
        else:
            assert enc.encode_text(t) == want, t[:80]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcehinort", min_size=1, max_size=400), st.integers(1, 40))
def test_tree_equals_whole(text, leaf):
    enc = bpe.encoder(WORD_BPE)
    s = enc.symbols(text)
    assert bpe.tree_merge(s, enc.merges, enc.split, leaf) == enc.merges.merge(s)


def test_token_query(docs, rows):
    enc = bpe.encoder(WORD_BPE)
    want = Counter()
    for i, t in rows:
        ids = enc.tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(enc.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(docs, WORD_BPE).collect()) == want


# 6 ----------------------------------------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    assert lines.distance(a, b) == row[-1]
    for most in (0, 2, 5):
        assert lines.distance(a, b, most) == row[-1] if row[-1] <= most else lines.distance(a, b, most) > most
        assert not lines.at_most(a, b, most) or row[-1] <= most


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_distances_side_by_side(seed):
    rnd = random.Random(seed)
    pairs = []
    for _ in range(60):
        a = "".join(rnd.choice("abcdeé日 ") for _ in range(rnd.choice([3, 30, 63, 64, 65, 130, 300])))
        b = "".join(c if rnd.random() > 0.15 else rnd.choice(["", "x", c + "y"]) for c in a)
        pairs.append((a, b) if rnd.random() < 0.8 else (a, b[::-1]))
    most = np.array([rnd.randint(0, 80) for _ in pairs])
    assert lines.within(pairs, most).tolist() == [lines.distance(a, b) <= k for (a, b), k in zip(pairs, most.tolist(), strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdef gé", min_size=25, max_size=70), min_size=1, max_size=3), st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 70), st.integers(0, 70), st.sampled_from(["", "a", "éb"])), max_size=20), max_size=5))
def test_groups_of_lines_against_all_pairs(base, plan):
    groups = []
    for edits in plan:
        own = [base[k % len(base)] for k, *_ in edits]
        groups.append([t[: a % len(t)] + new + t[a % len(t) + 1 : b] + t[b + 1 :] for t, (_, a, b, new) in zip(own, edits, strict=True)])

    def parts(group, pairs):
        label = list(range(len(group)))
        for x, y in pairs:
            label = [label[x] if k == label[y] else k for k in label]
        return sorted(sorted(i for i, k in enumerate(label) if k == v) for v in set(label))

    for group in groups:
        pairs = lines.alike(group, 0.8, [[1, 5]] * len(group))
        every = [(x, y) for x in range(len(group)) for y in range(x) if max(map(len, (group[x], group[y]))) * 0.2 + 1e-6 >= lines.distance(group[x], group[y])]
        assert parts(group, pairs) == parts(group, every)


@settings(max_examples=150, deadline=None)
@given(st.text("abcé日", min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "é", "日b"])), max_size=6))
def test_filter_drops_no_similar_pair(a, edits):
    b = a
    for at, new in edits:
        b = b[: at % (len(b) + 1)] + new + b[at % (len(b) + 1) + 1 :]
    if b and lines.similar(a, b, 0.8):
        x, y = lines.outlines([a, b])
        assert lines.may_be_similar(x[None], y[None], np.array([max(len(a), len(b))]), 0.8)[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcé日 ", min_size=17, max_size=90), min_size=1, max_size=8), st.sampled_from([(10, 1, 4), (12, 2, 5), (8, 3, 2)]))
def test_smallest_grams(texts, scheme):
    gram, rows, many = scheme
    texts = [t.encode() for t in texts]
    buf, size = np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts])
    got = lines.smallest_grams(buf, size, gram, rows, np.full(len(texts), many))
    keys = [sorted(got[1][got[0] == i].tolist()) for i in range(len(texts))]
    for i, t in enumerate(texts):
        own = sorted({int(x) >> 16 for x in lines._gram_hashes(np.frombuffer(t, dtype=np.uint8), gram)[: len(t) - gram + 1]})
        assert len(keys[i]) == max(1, min(many, len(own) - rows + 1))
        alone = lines.smallest_grams(np.frombuffer(t, dtype=np.uint8), np.array([len(t)]), gram, rows, np.array([many]), 1e9)
        assert sorted(alone[1].tolist()) == keys[i]  # neither its neighbours nor the limit matter


@pytest.mark.parametrize("crowd", [4096, 1])
def test_lines(spark, none, crowd, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 40))) for _ in range(40)]

    def edit(line):
        w = line.split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join(rnd.choice([edit(rnd.choice(base)), rnd.choice(base).upper() + "!", "", " short one"]) for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    rows += [(None, base[0]), (3, base[1]), (500, None), (501, ""), rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    mark = {t: x for t, x in df.select("text", F.xxhash64("text")).collect()}
    seen = []
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            norm = lines.normal_line(line)
            w = norm.split()
            if t is not None and len(w) >= 5:
                seen.append(((-(1 << 63) if i is None else i, mark[t], at), norm))
    norms = sorted({n for _, n in seen})
    fps = {n: int(lines.prints_of([n], 1)[3].view(np.uint64)[0]) for n in norms}
    linked = [(a, b) for a in range(len(norms)) for b in range(a) if (fps[norms[a]] ^ fps[norms[b]]).bit_count() <= 3 and lines.similar(norms[a], norms[b], 0.8)]
    assert len(linked) > 5
    group = dict(enumerate(range(len(norms))))
    group.update(dict(zip(*(x.tolist() for x in forest(*map(np.array, zip(*linked, strict=True)))), strict=True)))
    first = {}
    for at, n in seen:
        g = group[norms.index(n)]
        first[g] = min(first.get(g, at), at)
    gone = {at for at, n in seen if at != first[group[norms.index(n)]]}
    want = Counter()
    for i, t in rows:
        own = [] if t is None else t.split("\n")
        kept = [x for at, x in enumerate(own) if (-(1 << 63) if i is None else i, mark[t], at) not in gone]
        want[i, None if t is None else "\n".join(kept), len(own), len(own) - len(kept)] += 1
    assert Counter(tuple(r) for r in lines.dedup(df).collect()) == want
    assert lines.dedup(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=20), st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["", "a", "b", "ac"])), max_size=4))
def test_segments_miss_no_short_pair(a, edits):
    b = a
    for at, new in edits:
        b = b[: at % (len(b) + 1)] + new + b[at % (len(b) + 1) + 1 :]
    if b and len(b) <= lines.EXACT and lines.similar(a, b, 0.8):
        assert set(lines.segments(a, 0.8)) & set(lines.segments(b, 0.8))


def lines_of(rnd, n, size):
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(2000)]
    return [[rnd.choice(words) for _ in range(size)] for _ in range(n)], words


@pytest.mark.parametrize("crowd", [4096, 1])
def test_lines_by_edit_similarity_alone(spark, crowd, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rnd = random.Random(4)
    texts = []
    for size in (5, 8, 12, 20, 40):
        base, words = lines_of(rnd, 12, size)
        for w in base:
            other = list(w)
            other[rnd.randrange(size)] = rnd.choice(words)
            texts += [" ".join(w), " ".join(other)]
    norms = sorted(set(texts))
    want = [(a, b) for a in range(len(norms)) for b in range(a) if lines.similar(norms[a], norms[b], 0.8)]
    group = dict(zip(*(x.tolist() for x in forest(*map(np.array, zip(*want, strict=True)))), strict=True))
    should = len(group) - len(set(group.values()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = df.count() - lines.dedup(df, radius=None).filter("n_removed = 0").count()
    narrow = df.count() - lines.dedup(df).filter("n_removed = 0").count()
    assert should > 40 and 0.9 * should <= whole <= should and narrow < 0.5 * should


def test_short_lines_and_text_without_spaces(spark):
    long = "".join(chr(0x4E00 + 37 * i % 900) for i in range(60))
    rows = [(1, f"Menu\n{long}\nAll rights reserved.\n--"), (2, f"menu\nother text\nall rights reserved\n--\n\n{long[:30]}龘{long[31:]}"), (3, "\nMENU!\nHome")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df, radius=None, min_words=1).collect()}
    assert got == {1: rows[0][1], 2: "other text\n--\n", 3: "\nHome"}


def test_queries_judge_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "Menu\nx y"), (2, "menu\nz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op6_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_verified_of_a_crowd(monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 10)
    rnd = random.Random(2)
    texts = ["the same line of words number " + str(i) for i in range(60)]
    fp = np.array([rnd.choice([0, 1, 3, 1 << 40, 5 << 20]) for _ in texts], dtype=np.uint64)
    pairs = lines.verified(fp, texts, 3, 0.8, simhash.pivots())
    assert len(set(forest(*map(np.array, zip(*pairs, strict=True)))[1].tolist())) == 1


# 7 ----------------------------------------------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = WORD.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_prints(rng) -> np.ndarray:
    out = [int(b) for b in rng.integers(0, 2**63, 150, dtype=np.uint64)]
    for b in out[:20]:
        for _ in range(40):
            b ^= 1 << int(rng.integers(64))
            out.append(b)
    return np.unique(np.array(out, dtype=np.uint64))


def test_fingerprints_and_links(spark, monkeypatch):
    for t in ("", "a", "A b", "a b c d", "Ä B c d e  f\n g h", "x " * 9000 + "y"):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    fp = near_prints(np.random.default_rng(1))
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))

    def labels(a, b):
        out = np.arange(len(fp))
        node, root = forest(np.asarray(a), np.asarray(b))
        out[node] = root
        return out.tolist()

    want = labels(i, j)
    a, b = simhash.pairs_within(fp, 4, simhash.pivots())
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)}
    monkeypatch.setattr(simhash, "CROWDED", 50)
    assert labels(*simhash.links(fp, 4, simhash.pivots())) == want
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    for dense in (32, 0):
        e = simhash.near(df.select("fp", F.col("fp").alias("node")), 4, dense).toPandas()
        assert labels([at[x] for x in e.a], [at[x] for x in e.b]) == want


@pytest.mark.parametrize("per_task", [1 << 18, 100])
def test_components(spark, per_task, monkeypatch):
    monkeypatch.setattr(components_, "PER_TASK", per_task)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 350), rng.integers(0, 400, 350)
    chain = [(1000 + i, 1001 + i) for i in range(200)]
    edges = [*zip(a.tolist(), b.tolist(), strict=True), *chain]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    node, root = forest(*map(np.array, zip(*edges, strict=True)))
    assert all(got.get(n, n) == r for n, r in zip(node.tolist(), root.tolist(), strict=True))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs, rows, none, spark):
    prints = [(i, plain_fingerprint(t or "")) for i, t in rows]
    fps = sorted({f for _, f in prints})
    i, j = zip(*[(x, y) for x in range(len(fps)) for y in range(x) if (fps[x] ^ fps[y]).bit_count() <= 4] or [(0, 0)], strict=True)
    root = dict(enumerate(range(len(fps))))
    root.update(dict(zip(*(x.tolist() for x in forest(np.array(i), np.array(j))), strict=True)))
    low = {}
    for d, f in prints:
        if d is not None:
            r = root[fps.index(f)]
            low[r] = min(low.get(r, d), d)
    want = Counter((d, f"{f:016x}", low.get(root[fps.index(f)])) for d, f in prints)
    got = simhash.assign(docs).select("doc_id", simhash.hex_of(F.col("fp")), "component")
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = simhash.survivors(docs).collect()
    assert len(kept) == len(set(root.values())) and kept[0].asDict().keys() == set(docs.columns)
    assert simhash.assign(none).count() == 0 and simhash.survivors(none).count() == 0


# 8 ----------------------------------------------------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8, 40)] + [(None, 1, 0), (41, None, None)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r)[:7] for r in quality.judge(docs, quality.fit(docs, labels)).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t.encode())
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        own = [x for x in t.split("\n") if WORD.search(x.encode())]
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_quality_query(spark):
    got = queries.op8_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1


# 9 ----------------------------------------------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://A.Net/x?q": ("a.net", "/x", "net/", "block"), "https://m.example.net/en/1": ("m.example.net", "/en/1", "example.net/en/", "allow"), "http://xexample.com/de/": ("xexample.com", "/de/", None, "allow"),
        "http://example.com/de/?x": ("example.com", "/de/", "example.com/de/", "block"), "http://a.org/fr": ("a.org", "/fr", None, "allow"), "http://a.net": ("a.net", "", None, "allow"), "net/x": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "x://Ä.org/fr/a://b": ("Ä.org", "/fr/a://b", "org/fr/", "allow"), "http://org/fr/\nb#c": ("org", "/fr/\nb", "org/fr/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = [tuple(r)[1:5] for r in urls.judge(df, []).orderBy("page_id").collect()]
    assert got == list(cases.values())
    assert urls.judge(df.filter("false"), []).count() == 0


def test_mined_rules(spark):
    rnd = random.Random(4)
    host = lambda bad: ("win-casino" if bad else rnd.choice(["blog", "news", "casino"])) + rnd.choice([".a", ".b", ".c"]) + ".com"
    rows = [(f"http://{host(b)}/{rnd.choice(['en', 'de'])}/{rnd.randint(1, 99)}", b) for b in [i % 6 == 0 for i in range(400)]]
    rules = urls.mine(urls.labelled_tokens(spark.createDataFrame([*rows, (None, True), ("http://x.com/", None)], "url string, bad boolean")))
    assert [r.tokens for r in rules if r.tokens == ("w:win",)] == [("w:win",)]
    index = urls.Index(rules)
    for url, bad in rows:
        have = set(urls.tokens(url))
        plain = [r for r in rules if set(r.tokens) <= have]
        assert (index.match(url) is not None) == bool(plain) == bad
    pages = spark.createDataFrame([(1, "http://win-casino.d.com/fr/1"), (2, "http://blog.d.com/fr/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "allow"}
    nothing = urls.labelled_tokens(spark.createDataFrame([], "url string, bad boolean"))
    assert urls.mine(nothing) == [] and urls.rare(nothing).isEmpty()
    assert queries.op9_urls(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def plain_blocked(rows, support=urls.SUPPORT, least=urls.LEAST):
    """The labelled URLs that have some combination of tokens that is frequent enough and whose bound of confidence suffices."""
    import itertools

    sets = [(frozenset(urls.tokens(u)), b) for u, b in rows if u and urls.tokens(u)]
    seen = {}
    for have, bad in sets:
        for k in range(1, len(have) + 1):
            for c in itertools.combinations(sorted(have), k):
                n, hits = seen.get(c, (0, 0))
                seen[c] = n + 1, hits + bad
    need = max(support * len(sets), least)
    good = [frozenset(c) for c, (n, hits) in seen.items() if hits >= need and urls.wilson(hits, n, urls.Z) >= urls.CONFIDENCE]
    return [any(g <= have for g in good) for have, _ in sets]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mining_equals_all_combinations(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(260):
        host, a, b = rnd.choice(["x", "y", "z"]) + ".com", rnd.choice(["p", "q", "r"]), rnd.choice(["?id=1", "?ad=2", ""])
        sure = host[0] == "x" and a == "q" or b == "?ad=2" and a == "p"
        rows.append((f"http://{host}/{a}{b}", rnd.random() < (0.97 if sure else 0.1)))
    rules = urls.mine(urls.labelled_tokens(spark.createDataFrame(rows, "url string, bad boolean")))
    index = urls.Index(rules)
    want = plain_blocked(rows)
    assert [index.match(u) is not None for u, _ in rows] == want and any(want) and not all(want)


def test_long_urls_of_one_template(spark):
    """Tokens that come together are one, and others are bounded: a URL of 28 tokens takes no 2 ** 28 steps."""
    rnd = random.Random(6)
    query = "&".join(f"key{chr(97 + k)}=1" for k in range(24))
    rows = [(f"http://h{i % 90}.com/{i % 40}?{query if i % 2 else 'u=1'}&v={i}", False) for i in range(500)] + [(f"http://bad.biz/a?{query}&n{i}=1", True) for i in range(12)]
    loose = [(f"http://odd.net/?{'&'.join(f'k{chr(97 + k)}{chr(97 + k)}' for k in range(24) if rnd.random() < 0.8)}", True) for _ in range(60)]
    items = urls.labelled_tokens(spark.createDataFrame(rows + loose, "url string, bad boolean"))
    began = time.time()
    index = urls.Index(urls.mine(items))
    assert time.time() - began < 60
    assert all((index.match(u) is not None) == bad for u, bad in rows + loose)
    assert index.match("http://h1.com/?" + "x" * 200_000) is None


def test_rare_tokens(spark):
    """Twelve bad pages of one host are a rule however many other pages there are; support alone would need more of them."""
    rows = [(f"http://h{i % 700}.com/{i % 50}", False) for i in range(7000)] + [(f"http://pills.biz/x{i}", True) for i in range(12)] + [("http://mixed.biz/", i % 3 == 0) for i in range(30)]
    items = urls.labelled_tokens(spark.createDataFrame(rows, "url string, bad boolean"))
    assert urls.mine(items, support=0.01) == []
    rare = urls.rare(items)
    assert {r.token for r in rare.collect()} == {"h:pills.biz", "w:pills", "p:x0"}
    pages = spark.createDataFrame([(1, "http://www.pills.biz/new"), (1, "http://www.pills.biz/new"), (2, "http://mixed.biz/"), (3, None), (4, "https://pills.biz.net/")], "page_id long, url string")
    got = sorted((r.page_id, r.verdict, r.mined) for r in urls.judge(pages, [], rare).collect())
    assert got == [(1, "block", "w:pills"), (1, "block", "w:pills"), (2, "allow", None), (3, "allow", None), (4, "block", "w:pills")]


# 10 ---------------------------------------------------------------------------------------------------------------------------------------------------------


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.random((6, 9)), rng.random(6) * 5
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(0, 50)))
def test_plan_places_every_body_once(histogram):
    p = packing.plan(histogram, units=16)
    fill = Counter()
    for u, lo, hi, seq, copies, offset in p.places:
        for rank in range(lo, hi):
            k, i = divmod(rank - lo, copies)
            for x in range(u):
                fill[seq + k, offset + i * u + x] += 1
    full, last, end = p.parts()
    number = Counter()
    for u, n in enumerate(p.left):
        for _ in range(n):
            for size in packing.powers_of_two(u):
                number[size] += 1
    for size, n in number.items():
        for i in range(n):
            seq, whole = full[size]
            s, o = (seq + i // (16 // size), i % (16 // size) * size) if i < whole else last[size, i]
            for x in range(size):
                fill[s, o + x] += 1
    assert all(n == 1 for n in fill.values()) and sum(fill.values()) == sum(u * n for u, n in histogram.items())
    length = Counter(s for s, _ in fill)
    assert all(max(o for t, o in fill if t == s) == n - 1 and n & (n - 1) == 0 for s, n in length.items()) and len(length) <= end


def test_packing(docs, rows, none):
    enc = bpe.encoder(BYTE_BPE, bpe.ByteEncoder)
    got = packing.pack(docs, BYTE_BPE).toPandas()
    length = got.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in length)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    ids = Counter()
    for i, t in rows:
        x = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        ids[i, len(x)] += len(x)
    by = Counter()
    for r in got.itertuples():
        by[None if np.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens] += r.length
    assert by == ids
    unique = {i: t for i, t in rows if i is not None and sum(j == i for j, _ in rows) == 1}
    for i, t in unique.items():
        x = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        b, at = struct.pack(f"<{len(x)}I", *x), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and zlib.crc32(b[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(x)
    assert packing.pack(none, BYTE_BPE).count() == 0
