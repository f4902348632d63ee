"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy, edge cases included."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import bpecount, chat, dac, decontaminate, langid, ngram_join, ngrams, packing, quality, suffix_dedup, textcore, tokens, toxicity
from weftgraph.llm.runtime import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit string, group string, bucket long, rep long, keys string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, tiny and long texts, ties, repeated rows, and columns named like the operators' own."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, long = prose(120), prose(6000)
    shared = prose(70)
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", base, base, base.upper(), base.replace(" ", "\n", 5), base + " extra tail words", prose(80) + " " + shared, shared + " " + prose(90)]
    texts += [long, "x" * 5000, "héllo wörld " * 60, "naïve\x00byte\x0b", "a\n" * 300, prose(300), "日本語 " * 80]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[13], (None, base, "en", "s1", 1)]
    return spark.createDataFrame([(*r, "u", "g", 7, 8, "k") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- 1 packing -----------------------------------------------------------------------------------------------------------


def test_pack_lengths_cover_everything():
    rnd = random.Random(0)
    for _ in range(40):
        lengths = [rnd.choice([1, 5, 100, 4095, 4096, 4097, 9000, rnd.randint(1, 3000)]) for _ in range(rnd.randint(0, 60))]
        out = packing.pack_lengths(lengths)
        seen = collections.defaultdict(list)
        for seq in out:
            assert 0 < sum(n for _, _, n in seq) <= 4096
            for item, start, n in seq:
                seen[item].append((start, n))
        for item, n in enumerate(lengths):
            at = 0
            for start, k in sorted(seen[item]):
                assert start == at
                at += k
            assert at == n
        sizes = [sum(n for _, _, n in seq) for seq in out]
        assert sum(4096 - s for s in sizes if s & (s - 1)) <= 0.1 * 4096 * len(sizes)


def test_tree_takes_the_tightest():
    rnd = random.Random(1)
    tree, rooms = packing.CapacityTree(64), []
    for i in range(400):
        if rnd.random() < 0.5:
            room = rnd.randint(1, 64)
            tree.add(room, i)
            rooms.append(room)
        else:
            need = rnd.randint(1, 64)
            want = min((r for r in rooms if r >= need), default=None)
            got = tree.take(need)
            assert (got[0] if got else None) == want
            if want:
                rooms.remove(want)


def test_pack(odd, empty):
    tok = Tokenizer.from_file(tokens.default_path())
    out = packing.pack(odd).collect()
    docs = collections.defaultdict(list)
    for r in out:
        docs[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
    for doc, text in plain(odd):
        want = np.asarray(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        times = sum(1 for d, _ in plain(odd) if d == doc)
        got = sorted(docs[doc])[:: times]
        assert b"".join(x[1] for x in got) == want and all(x[2] == len(want) // 4 for x in got)
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 4096
    assert packing.pack(empty).count() == 0


# ---- 2 decontamination ----------------------------------------------------------------------------------------------------


def test_decontamination(spark, odd, empty):
    rnd = random.Random(8)
    item = " ".join("".join(rnd.choice("bcdfgklmp") for _ in range(5)) for _ in range(40))
    words = item.split()
    near = " ".join(words[:-1] + ["zzzz"])
    far = " ".join(w if i % 4 else "zzzz" for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "few words only"), (5, "unrelated text of enough words to be an item here")], "item_id long, text string")
    more = spark.createDataFrame([(100, f"before it {item.upper()} after"), (101, "x " + near.replace(" ", ", ")), (102, far), (103, item), (104, None)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (103, 1)}
    assert got[100, 1]["start_word"] == 2 and got[100, 1]["similarity"] == pytest.approx(1.0) and got[100, 1]["hamming"] == 0
    assert 0.8 <= got[101, 1]["similarity"] < 1
    blocks = decontaminate.matches(docs, bench, block_items=1)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(got)
    kept = decontaminate.keep_clean(more, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [102, 104]
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.where("false")).count() == 0


def test_weights_do_not_depend_on_blocks(spark):
    """Boilerplate held by all items weighs little in every block; similarities around the threshold stay as they are."""
    rnd = random.Random(9)
    made = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common = made(30)
    items = [(i, " ".join(common + made(25))) for i in range(12)]
    near = []
    for i, text in items:
        w = text.split()
        for j, at in enumerate((3, 32, 42, 54)):
            near.append((10 * i + j, " ".join(w[:at] + ["zz"] + w[at + 1 :])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(near, "doc_id long, text string")
    rows = lambda df: sorted((r["doc_id"], r["item_id"], r["start_word"], r["hamming"], round(r["similarity"], 9)) for r in df.collect())
    whole = rows(decontaminate.matches(docs, bench))
    assert whole and rows(decontaminate.matches(docs, bench, block_items=1)) == rows(decontaminate.matches(docs, bench, block_items=5)) == whole


@pytest.mark.parametrize("radius,probing", [(18, False), (18, True), (6, True), (2, False)])
def test_multi_index_is_complete(radius, probing, monkeypatch):
    """All items within the radius are found, by probing keys or by holding items against them, and others seldom become candidates."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(20))) for i in range(300)]
    items = decontaminate.Items(rows, 5, radius)
    if probing:
        # more rows than keys, so keys are probed; the added ones repeat an item and fail the exact distance
        monkeypatch.setattr(decontaminate, "PROBES", 1 << 14)
        far = np.full(3000, 0xFFFF, np.uint16)
        for key, (values, own) in items.tables.items():
            values, own = np.concatenate([values, far]), np.concatenate([own, np.full(3000, own[0])])
            order = np.argsort(values, kind="stable")
            items.tables[key] = (values[order], own[order])
    prints = []
    for _ in range(200):
        f = int(items.prints[rnd.randrange(300)])
        for b in rnd.sample(range(64), rnd.randint(0, radius + 3)):
            f ^= 1 << b
        prints.append(f)
    w, i = items.near(np.array(prints, np.uint64), 20)
    want = {(x, r) for x, f in enumerate(prints) for r in range(300) if (int(items.prints[r]) ^ f).bit_count() <= radius}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want
    assert sum(decontaminate.shares(radius)) + 4 == radius + 1


def brute_matches(docs, bench, k=5, least=0.8):
    """The best window of every document and item, over all windows of the item's size, without fingerprints."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    items = {i: grams(words(t)) for i, t in bench if t is not None}
    holders = collections.Counter(g for gs in items.values() for g in set(gs))
    weight = lambda g: round((1 + np.log(len(items) / holders.get(g, 1))) * decontaminate.UNIT)
    out = {}
    for doc, text in docs:
        own = grams(words(text))
        for item, gs in items.items():
            n = min(len(gs), len(own))
            if not gs or not n:
                continue
            b = collections.Counter(gs)
            for s in range(len(own) - n + 1):
                a = collections.Counter(own[s : s + n])
                if not a.keys() & b.keys():
                    continue
                low = sum(weight(g) * min(c, b[g]) for g, c in a.items())
                high = sum(weight(g) * max(a[g], b[g]) for g in a.keys() | b.keys())
                if low / high >= least and (low / high, -s) > out.get((doc, item), (0, 0)):
                    out[doc, item] = (low / high, -s)
    return {key: (-s, pytest.approx(v, abs=1e-9)) for key, (v, s) in out.items()}


@pytest.mark.parametrize("blocks", [20_000, 7])
def test_recall_over_all_windows(spark, blocks):
    """Items of every size, damaged in every way, at every place, against all windows: no match is lost and none is made up."""
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(3000)}"
    stem = [word() for _ in range(12)]
    bench = [(i, " ".join((stem if i % 5 == 0 else []) + [word() for _ in range(rnd.randint(8, 45))])) for i in range(60)]
    docs = []
    for d in range(400):
        w = rnd.choice(bench)[1].split()
        for _ in range(rnd.randint(0, max(1, len(w) // 12))):
            at = rnd.randrange(len(w))
            kind = rnd.randrange(4)
            w = w[:at] + w[at + 1 :] if kind == 0 else w[:at] + [word()] + w[at:] if kind == 1 else w[:at] + [word()] + w[at + 1 :] if kind == 2 else w[rnd.randint(0, 2) :]
        docs.append((d, " ".join([word() for _ in range(rnd.randint(0, 60))] + w + [word() for _ in range(rnd.randint(0, 60))])))
    want = brute_matches(docs, bench)
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_items=blocks)
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in got.collect()}
    assert len(want) > 150 and not got.keys() - want.keys()
    assert len(got) >= 0.99 * len(want)
    assert sum(got[key] == want[key] for key in got) >= 0.99 * len(got)


# ---- 3 chat ---------------------------------------------------------------------------------------------------------------


def test_transcripts():
    m = chat.Model()
    assert chat.turns("Human: hi there?\nGPT: hello\nmore: things here\n\nHuman: ok", m) == [("user", "hi there?"), ("assistant", "hello\nmore: things here\n"), ("user", "ok")]
    assert [r for r, _ in chat.turns("Alice: how are you?\nBob: fine\nAlice: great\nBob: yes", m)] == ["user", "assistant", "user", "assistant"]
    assert chat.turns("### System\nbe nice\n### User\nq1?\n### Assistant\na1\nline2", m) == [("system", "be nice"), ("user", "q1?"), ("assistant", "a1\nline2")]
    assert chat.turns("<|user|>\nhey\n<|assistant|>\nyo", m) == [("user", "hey"), ("assistant", "yo")]
    assert chat.turns("", m) == [("user", "")]


def test_viterbi_is_the_best_path():
    import itertools

    m = chat.Model()
    lines = ["Bot: a", "b?", "", "Carol: d"]
    got = [(r, f) for r, f, _ in m.decode(lines)]
    best, top = None, -1e18
    for path in itertools.product(range(len(chat.STATES)), repeat=len(lines)):
        total = m.start[path[0]]
        for i, s in enumerate(path):
            mark, rest = chat.marker(lines[i])
            total += m.mark[s][mark] + sum(t[v] for t, v in zip(m.feature[s], chat.features(rest, i > 0 and not lines[i - 1].strip()), strict=True))
            total += m.trans[path[i - 1]][s] if i else 0
        if total > top:
            best, top = path, total
    assert got == [chat.STATES[s] for s in best]


def test_pieces_are_decoded_like_the_whole(spark, monkeypatch):
    """A conversation of 300 turns, unmarked in long stretches, in pieces of 4 turns combined 3 at a time."""
    rnd = random.Random(7)
    rows = []
    for conv in range(4):
        role = "user"
        for turn in range((300, 3, 41, 1)[conv]):
            lines = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 9))) + rnd.choice(["", "?", " "]) for _ in range(rnd.randint(1, 4))]
            rows.append((conv, turn, role if rnd.random() < 0.3 else None, "\n".join(lines)))
            role = "assistant" if role == "user" else "user"
    conv = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    keys = [("start", r) for r in chat.ROLES] + [("next", a, b) for a in chat.ROLES for b in chat.ROLES] + [("more", r) for r in chat.ROLES]
    keys += [(k, r, first, v) for k, n in (("gap", 2), ("question", 2), ("length", 4)) for r in chat.ROLES for first in (True, False) for v in range(n)]
    model = chat.Model({k: rnd.random() for k in keys})  # so that no two paths weigh the same
    said = {}
    for r in chat.marked(conv).orderBy("conv_id", "turn").collect():
        said.setdefault(r["conv_id"], []).append(r["line"])
    want = {c: chat.turns("\n".join(lines), model) for c, lines in said.items()}
    for piece, fan in ((4, 3), (1, 2), (128, 256)):
        monkeypatch.setattr(chat, "PIECE", piece)
        monkeypatch.setattr(chat, "FAN", fan)
        got = {}
        for r in chat.format_chats(conv, model).orderBy("conv_id", "turn_no").collect():
            got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert got == want, (piece, fan)


def test_hidden_roles_are_recovered(spark):
    """Fitted on three quarters of the conversations; in the others every marker but the first is a bare name."""
    conv = table(spark, "/root/testdata/sf0.1", "conversations")
    model = chat.fit(chat.marked(conv).where(chat.learned_from()))
    out = chat.marked(conv).where(~chat.learned_from()).orderBy("conv_id", "turn").collect()
    talks = {}
    for r in out:
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    right = total = 0
    for talk in talks.values():
        lines = [(f"{role.title()}: " if i == 0 else rnd_name) + text for i, (role, text) in enumerate(talk) for rnd_name in ("Robin: ",)]
        got = chat.turns("\n".join(lines), model)
        total += len(talk)
        right += sum(a == b for a, b in zip(got, talk, strict=False)) if len(got) == len(talk) else 0
    assert total > 500 and right >= 0.97 * total


def test_chat_table(spark, monkeypatch):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "ASSISTANT", "a\nb"), (2, 0, "system", None), (2, 1, None, "no role"), (2, 2, "assistant", ""), (None, 0, "user", "x"), (3, 200, "user", "late"), (3, 0, "user", "early"), (1, 0, "user", "Hi?")]
    rows += [(4, None, "user", "q"), (4, 1, "assistant", "long " * 40_000), (5, 3, "user", "same"), (5, 3, "user", "same"), (5, 3, "assistant", "same")]
    conv = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"piece": F.lit("clash"), "ord": F.lit(1), "_c": F.lit(2)})
    for piece in (128, 1):
        monkeypatch.setattr(chat, "PIECE", piece)
        got = {(r["conv_id"], r["turn_no"]): (r["role"], r["text"]) for r in chat.format_chats(conv, chat.Model()).collect()}
        assert got[1, 0] == got[1, 1] == ("user", "Hi?") and got[1, 2] == ("assistant", "a\nb")
        assert got[2, 0][0] == "system" and got[None, 0] == ("user", "x")
        assert got[3, 0] == ("user", "early") and got[3, 1] == ("user", "late")
        assert got[4, 0] == ("user", "q") and got[4, 1] == ("assistant", "long " * 40_000)
        assert [got[5, i] for i in range(3)] == [("assistant", "same"), ("user", "same"), ("user", "same")]
    assert chat.format_chats(conv.where("false")).count() == 0


# ---- 4 counts, 8 files ----------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(odd, empty):
    tok = Tokenizer.from_file(tokens.default_path())
    rnd = random.Random(1)
    alphabet = ["a", "A", ".", ",", "'s", " ", "\n", "1", "é", "́", "Σ", "<|endoftext|>", "½", "🙂", "ß", "İ", "　", "\x1c", "don't"]
    bpe, ids = bpecount.HeapBpe(tokens.default_path()), tokens.tokenizer(tokens.default_path())
    for text in ["", "a<|endoftext|>b", "it's WE'LL", "A" * 3000, *["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]]:
        want = tok.encode(text, add_special_tokens=False).ids
        assert bpe.count(text) == len(want)
        assert ids.ids(text) == np.asarray(want, "<u4").tobytes()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in bpecount.token_counts(odd).collect()), key=repr)
    assert got == sorted(((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in plain(odd)), key=repr)
    assert bpecount.token_counts(empty).count() == 0


@pytest.mark.parametrize("bits", [3, 8])
def test_shard_round_trip(bits):
    rnd = random.Random(bits)
    arrays = [np.asarray([rnd.choice([0, 1, 255, 256, 49407, 2**32 - 1, rnd.randrange(70000)]) for _ in range(rnd.choice([0, 1, 700, 1500]))], "<u4") for _ in range(12)]
    shard = dac.Shard(dac.encode_shard([None, *range(11)], [a.tobytes() for a in arrays], bits))
    flat = np.concatenate(arrays)
    assert all(shard.token(i) == flat[i] for i in range(0, len(flat), 7))
    assert all(shard.document(k).tobytes() == a.tobytes() for k, a in enumerate(arrays))
    a, b = sorted(rnd.sample(range(len(flat)), 2))
    assert (shard.span(a, b) == flat[a:b]).all() and shard.null.tolist() == [True] + [False] * 11
    with pytest.raises(IndexError):
        shard.token(len(flat))


def test_shards_are_row_groups_of_their_own(spark, odd, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(dac, "SHARD_IDS", 500)
    dac.write_tokens(odd, f"file://{tmp_path}/s", partitions=2)
    groups = 0
    for f in (tmp_path / "s" / "shards").glob("*.parquet"):
        meta = pq.read_metadata(f)
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).num_rows == 1 and all(meta.row_group(g).column(c).compression == "UNCOMPRESSED" for c in range(meta.num_columns))
    assert groups > 4
    whole = {(r["doc_id"], r["ids"]) for r in dac.read_tokens(spark, f"file://{tmp_path}/s").collect()}
    for doc, ids in whole:
        ids = np.frombuffer(ids, "<u4").tolist()
        assert dac.lookup(spark, f"file://{tmp_path}/s", doc, len(ids) - 1) == 1


def test_token_files(spark, odd, empty, tmp_path):
    tok = Tokenizer.from_file(tokens.default_path())
    dac.write_tokens(odd, f"file://{tmp_path}/t")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in dac.read_tokens(spark, f"file://{tmp_path}/t").collect()))
    want, at = [], 0
    for doc, text in sorted(plain(odd), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.asarray(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((at, doc, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    first = {}
    for r in sorted(dac.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"]):
        first.setdefault(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())
    for doc in (None, 0, 13, 6):
        for i in {0, len(first[doc]) // 2, len(first[doc]) - 1}:
            assert dac.lookup(spark, f"file://{tmp_path}/t", doc, i) == first[doc][i]
    with pytest.raises(IndexError):
        dac.lookup(spark, f"file://{tmp_path}/t", 0, len(first[0]))
    with pytest.raises(KeyError):
        dac.lookup(spark, f"file://{tmp_path}/t", 999, 0)
    dac.write_tokens(empty, f"file://{tmp_path}/e")
    assert dac.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


# ---- 5 join ---------------------------------------------------------------------------------------------------------------


def brute_classes(rows, k, num, den):
    sets = {}
    for doc, text in rows:
        w = words_of(text)
        sets[doc] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (3, 50, 100)])
def test_classes(spark, odd, empty, k, num, den, monkeypatch):
    rnd = random.Random(k)
    vocab = [f"w{i}" for i in range(150)]
    rows = [(r, t) for r, t in plain(odd) if r is not None]
    for family in range(6):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 150))]
        for j in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((1000 + family * 100 + j, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 5)  # classes over several blocks
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_classes(docs, k, num, den).collect()}
    assert got == brute_classes(rows, k, num, den)


def test_chain_of_shared_ngrams(spark, monkeypatch):
    """Each document shares rare n-grams with its neighbours and links with none: work stays in proportion to the documents."""
    rnd = random.Random(4)
    passages = [[f"p{i}x{j}" for j in range(12)] for i in range(401)]
    rows = [(i, " ".join(passages[i] + [f"c{rnd.randrange(40)}" for _ in range(20)] + passages[i + 1])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda work, num, den: seen.append(work.count()) or verify(work, num, den))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(docs, 3, 90, 100).collect()}
    assert got == {i: i for i, _ in rows}
    assert seen[0] <= 4 * len(rows)  # not the square of them


def test_many_short_rows_in_one_batch(spark):
    """More rows in an Arrow batch than 16 bits can number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        docs = spark.range(0, 100_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 50_000, F.lit("b")).alias("text"))
        wrong = ngram_join.similarity_classes(docs).where("component_id != doc_id % 50000 or n_shingles != 1").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert wrong == 0


def test_one_id_on_two_texts(spark):
    """Both texts are members; each has its own size and its own links."""
    one, two = " ".join(f"u{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(5, one), (5, two), (7, one + " more"), (9, two + " more")], "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.similarity_classes(docs, 3, 90, 100).collect())
    assert got == [(5, 28, 5), (5, 28, 5), (7, 29, 5), (9, 29, 5)]


def test_classes_edge(odd, empty):
    out = ngram_join.similarity_classes(odd).collect()
    assert len(out) == odd.count()
    assert [(r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is None] == [(None, None)]
    assert ngram_join.similarity_classes(empty).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert {6, 8, 9} & {r["doc_id"] for r in kept.collect()} == {6}


# ---- 6 languages ----------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark, sf, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n = got.count()
    assert n > 150 and got.where("lang_pred = lang").count() >= 0.97 * n
    out = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and out[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(empty).count() == 0
    blank = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


def test_code_lengths_are_exact():
    """Vectorised lengths equal the escape chain followed byte by byte."""
    corpus = {"a": b"abracadabra abra", "b": b"banana bandana"}
    grams = collections.defaultdict(list)
    counts = {}
    for i, (name, data) in enumerate(corpus.items()):
        raw = np.frombuffer(data, np.uint8)
        for k in (1, 2, 3, 4):
            c = collections.Counter((ngrams.codes(raw, np.array([0, len(raw)])).astype(np.int64) & ((1 << 8 * k) - 1)).tolist())
            counts[name, k] = c
            grams[k] += [(i, g, n) for g, n in c.items()]
    trees = langid.Trees(["a", "b"], grams).prepare()

    def bits(name, gram, k):
        if k == 0:
            return 8.0
        c = counts[name, k]
        own = {g: n for g, n in c.items() if g >> 8 == gram >> 8}
        low = bits(name, gram & ((1 << 8 * (k - 1)) - 1), k - 1)
        if not own:
            return low
        n, d = sum(own.values()), len(own)
        return -np.log2(own[gram] / (n + d)) if gram in own else -np.log2(d / (n + d)) + low

    texts = [b"abra", b"", b"xyz banana", b"aband"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = ngrams.codes(raw, off).tolist()
    got = trees.lengths(raw, off)
    for d in range(len(texts)):
        for i, name in enumerate("ab"):
            assert got[d, i] == pytest.approx(sum(bits(name, g, 4) for g in codes[off[d] : off[d + 1]]), rel=1e-5)


def test_language_model_keeps_every_gram(spark, odd):
    """Over the 150,000 pairs of an order that used to stay; parts of the longest order add up to the whole."""
    rnd = random.Random(6)
    rows = [(i, "".join(chr(rnd.randrange(33, 127)) for _ in range(4000)), lang) for i, lang in enumerate(["aa"] * 47 + ["bb"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = len({(lang, ("\n\n\n" + t)[i : i + 4]) for _, t, lang in rows for i in range(len(t))})
    parts = langid.learn(docs)
    trees = parts.trees(0)
    assert want > 150_000 and parts.number == 1
    raw = np.frombuffer(rows[-1][1].encode(), np.uint8)
    found = trees.bits(ngrams.codes(raw, np.array([0, len(raw)])), 4)
    assert len(trees.tables[4][0]) == len({("\n\n\n" + t)[i : i + 4] for _, t, _ in rows for i in range(len(t))})
    assert (found[1] < 8).all()  # the rare language has all of its own contexts
    both = odd.unionByName(odd.limit(7))
    one = langid.identify(both).collect()
    split = langid.identify(both, cells=50).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"], round(r["score"], 6))
    assert sorted(map(key, one)) == sorted(map(key, split)) and langid.learn(both, cells=50).number > 2


# ---- 7 quality ------------------------------------------------------------------------------------------------------------


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics(spark, sf, odd, empty):
    for docs in (odd, table(spark, sf, "documents")):
        got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.text_stats(docs).collect()), key=repr)
        assert got == sorted(((d, *brute_stats(t)) for d, t in plain(docs)), key=repr)
    assert quality.quality_rules(empty).count() == 0
    out = quality.quality_rules(odd).collect()
    assert len(out) == odd.count() and all(r["kept"] is not None and not (r["kept"] and r["base_failed"]) for r in out)
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_rejects_junk_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.quality_rules(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed")
    n = {r["quality"]: (r["n"], r["k"]) for r in got.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()}
    assert n[1][1] >= 0.995 * n[1][0] and n[0][1] <= 0.2 * n[0][0]


def mcd(x, support=0.75):
    """The documented estimate of one group on arrays, from many random starts besides."""
    floor = np.diag([quality.FLOOR[d] ** 2 for d in quality.DIMS])
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def steps(inside):
        for _ in range(60):
            m, c = x[inside].mean(0), np.cov(x[inside].T, bias=True) + floor
            bins = np.floor(np.log2(dist(m, c) + 1e-9) * quality.LOG_GRID)
            now = bins <= np.sort(bins)[int(np.ceil(len(x) * support)) - 1]
            if (now == inside).all():
                break
            inside = now
        return np.linalg.slogdet(np.cov(x[inside].T, bias=True) + floor)[1], inside

    rng = np.random.default_rng(0)
    best = min((steps(np.isin(np.arange(len(x)), rng.choice(len(x), 8, replace=False))) for _ in range(60)), key=lambda r: r[0])
    m, c = x[best[1]].mean(0), np.cov(x[best[1]].T, bias=True) * quality.consistency(support) + floor
    good = dist(m, c) <= quality.chi2_quantile(0.025, 4)
    return best[0], dist(x[good].mean(0), np.cov(x[good].T, bias=True) * quality.consistency(0.975) + floor)


def test_verdicts_equal_brute_force(spark):
    """Per language and source, a null source and a pool of small groups among them: distances and verdicts of an independent estimate."""
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for lang, source, size in (("a", "s", 400), ("a", None, 300), ("b", "s", 250), ("b", "t", 30), ("b", "u", 25), (None, "z", 12)):
        shift = rng.normal(0, 0.2, 4)
        for i in range(size):
            v = np.array([1.6, 1.0, 0.02, 0.05]) + shift * [0.5, 1, 0, 0] + rng.normal(0, [0.08, 0.5, 0.02, 0.02])
            if i % 9 == 0:
                v += [0, rng.uniform(2, 5), 0, 0] if i % 2 else [0, 0, rng.uniform(0.5, 0.9), rng.uniform(0.1, 0.4)]
            rows.append((lang, source, *(float(max(0, t)) for t in v)))
            n += 1
    unit = lambda lang, source: "p" if (lang, source) in (("b", "t"), ("b", "u")) else f"{lang}/{source}"
    points = spark.createDataFrame([(unit(a, b), i, *v) for i, (a, b, *v) in enumerate(rows)], "unit string, i int, v_len double, v_sym double, v_dup double, v_rep double")
    params = quality.estimate(points.drop("i"))
    got = {r["i"]: r["d_mcd"] for r in quality._distances(points.join(params, "unit"), ["mcd"]).collect()}
    cut = quality.chi2_quantile(1e-12, 4)
    for u in {unit(a, b) for a, b, *_ in rows}:
        own = [i for i, (a, b, *_) in enumerate(rows) if unit(a, b) == u]
        if len(own) < 40:
            continue
        det, want = mcd(np.array([rows[i][2:] for i in own]))
        mine = np.array([got[i] for i in own])
        assert ((mine > cut) == (want > cut)).all() and np.corrcoef(mine, want)[0, 1] > 0.999
    # any partitioning gives the same
    again = quality.estimate(points.drop("i").repartition(7))
    one, two = ({r["unit"]: r["det_mcd"] for r in p.collect()} for p in (params, again))
    assert one.keys() == two.keys() and all(one[u] == pytest.approx(two[u], abs=1e-6) for u in one)


def test_null_source_is_a_group_of_its_own(spark):
    """It used to share its name with the pool of its language's small groups."""
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(3, 7))) for _ in range(900)]
    text = lambda long: " ".join(rnd.choice(vocab) * (3 if long else 1) for _ in range(80))
    rows = [(i, text(False), "a", None) for i in range(60)] + [(100 + i, text(True), "a", f"s{i % 3}") for i in range(60)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r["kept"] and r["distance2"] < 40 for r in got.values())


def test_chi_square():
    assert quality.chi2_quantile(0.05, 4) == pytest.approx(9.4877, abs=1e-3) and quality.chi2_quantile(0.001, 6) == pytest.approx(22.4577, abs=1e-3)
    assert quality.chi2_cdf(3.3567, 4) == pytest.approx(0.5, abs=1e-4) and 1.4 < quality.consistency(0.75) < 1.6


def test_each_quality_statistic_rejects_by_itself(spark):
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(3, 7))) for _ in range(2000)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows = [(i, " ".join(prose(200))) for i in range(200)]
    few, block = prose(12), prose(46)
    bad = {
        900: " ".join(prose(300)) + "\n" + "\n".join(rnd.choice(few) for _ in range(90)),  # lines
        901: " ".join(block + prose(54) + block + prose(54)),  # words
        902: " ".join(w + "#&" for w in prose(200)),  # symbols
        903: " ".join(w * 4 for w in prose(200)),  # word length
    }
    docs = spark.createDataFrame(rows + list(bad.items()), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in bad), {i: got[i] for i in bad}
    assert got[900]["n_repeat_words"] < 0.1 * got[900]["n_words"] and got[901]["n_dup_lines"] == 0
    assert all(got[i]["kept"] for i, _ in rows)


# ---- 9 repeats ------------------------------------------------------------------------------------------------------------


def brute_removals(rows, length, texts=False):
    count = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        if texts:
            out.append((doc, kept.decode("utf-8", "ignore")))
            continue
        out.append((doc, len(t), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_order_and_repeats():
    rnd = random.Random(5)
    for trial in range(80):
        segs = [bytes(rnd.choice(b"ab\x00" if trial % 2 else b"abc") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 6))]
        text = np.frombuffer(b"".join(segs), np.uint8)
        ends = np.repeat(np.cumsum([len(s) for s in segs]), [len(s) for s in segs])
        order, _ = suffix_dedup.two_stage_order(text, ends, np.ones(len(text), bool))
        suffixes = [bytes(text[p : ends[p]]) for p in order]
        assert len(set(order.tolist())) == len(text) and suffixes == sorted(suffixes)
        long = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(16, 60))) for _ in range(8)})
        count = collections.Counter(s[i : i + 16] for s in long for i in range(len(s) - 15))
        for hit, s in zip(suffix_dedup.repeated_windows(long, [len(s) - 15 for s in long], 16), long, strict=True):
            assert hit.tolist() == [count[s[i : i + 16]] > 1 for i in range(len(s) - 15)]


@pytest.mark.parametrize("length,hot", [(200, 20_000), (64, 20_000), (200, 1), (64, 3)])
def test_removals(spark, odd, empty, length, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rows = [(d, (t or "").encode()) for d, t in plain(odd) if d is not None]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removals(odd, length).collect() if r["doc_id"] is not None), key=repr)
    assert got == brute_removals(rows, length)
    assert suffix_dedup.removals(empty).count() == 0
    out = suffix_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    rnd = random.Random(2)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    docs = spark.createDataFrame([(1, body), (2, "zz" + body[4000:4600] + "yy")], "doc_id long, text string")
    pieces = list(suffix_dedup._pieces(iter(docs.toArrow().to_batches()), 200))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    cut = list(suffix_dedup._pieces(iter(docs.toArrow().to_batches()), 200))
    assert len(cut) > len(pieces)
    runs = lambda ps: sorted({(i[r], int(b[r] + s + k)) for i, b, raw, off in ps for r, s, n, _, _ in zip(*map(np.ndarray.tolist, suffix_dedup.anchor_runs(raw, off, 200)), strict=True) for k in range(n)})
    assert runs(pieces) == runs(cut) == sorted({(1, i) for i in range(len(body) - 199)} | {(2, i) for i in range(604 - 199)})


# ---- 10 toxicity ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(3, 7))) for _ in range(300)]
    insults = ["moron", "scumbag", "wretch", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(vocab) for _ in range(60)]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(insults)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (9002, "you m0r0n"), (9003, "s c u m b a g"), (9004, "patheeeetic wr3tch"), (9005, " ".join(vocab[:50])), (None, "moron")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(toxic):
    docs, labels = toxic
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for d, r in got.items() if d is not None and d < 600 and r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.98 * len(held)
    assert all(got[i]["predicted"] == 1 for i in (9002, 9003, 9004)), {i: got[i]["score"] for i in (9002, 9003, 9004)}
    assert all(got[i]["predicted"] == 0 for i in (9000, 9001, 9005))
    none = toxicity.toxicity(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_lattice():
    slots = toxicity.Restorer.lattice("i-d10o0t")
    assert [len(s) for s in slots] == [1, 2, 1, 3, 2, 1, 2, 1]
    assert toxicity.suspicious("l33t") and not toxicity.suspicious("2024") and not toxicity.suspicious("plain")


def test_rare_stems_are_learned_at_any_size(spark):
    """A stem in 5 of over 600 toxic documents (less than 1 %) and in no clean one stands out from chance."""
    free = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    bad = free[:620]
    rows = [(i, "moron of the plain words here" if i in set(bad) else "some of the plain words here") for i in free]
    rows[:5] = [(i, "grumblo " + t) for i, t in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in set(bad))) for i in free], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels).weights
    assert "moron" in weights and "grumblo" in weights and "plain" not in weights


def test_long_and_crowded_disguises_are_decoded_whole(spark, toxic):
    docs, labels = toxic
    model = toxicity.learn(docs, labels)
    m = model.ready()
    clean = " ".join("neat" for _ in range(40))
    far = " ".join(" ".join(clean.replace(" ", "")))[:299].strip()
    hidden = {
        "run over 128 characters": far + " s c u m b a g",
        "stretched token": "mor" + "o" * 80 + "n",
        "dotted token": ".".join("lineneattent" * 6) + ".s.c.u.m.b.a.g",
        "letters before it": "s u r e s c u m b a g",
        "letters around it": "y o u m o r o n s o",
    }
    found = {k: m.evidence(t)[0] > 0 for k, t in hidden.items()}
    assert all(found.values()), found
    assert m.evidence(far)[0] == 0


def test_signs_at_the_end_and_without_letters_are_decoded(spark):
    clean = "a pie has some sass but the ant and the pit are at home with a glass of tea".split()
    foul = "what an ass they piss and hiss like an ass in a mess".split()
    rows = [(i, " ".join((foul if i % 3 == 0 else clean)[(i * k) % 9 :] + ["tea"])) for i in range(300) for k in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    r = toxicity.learn(docs, labels).ready().reader
    want = {"a$$": "ass", "pi$$": "piss", "4$$": "ass", "@$$": "ass", "p!$$": "piss", "(a$$)": "ass", "a$$!": "ass", "tea!!": "tea", "ant*": "ant", "home&": "home&", "455": "455", "12.50": "12.50"}
    got = {t: r.word(t) for t in want}
    got["(a$$)"] = got["(a$$)"].lstrip("(c")
    assert got == want


def test_restoring_is_exact(toxic):
    """The cheapest of all readings, also where more than 64 contexts are open."""
    import itertools

    docs, labels = toxic
    r = toxicity.learn(docs, labels).ready().reader.restorer

    def cost(readings):
        c, total = b"\n\n ", 0.0
        for reading, price in readings:
            total += price
            for byte in reading.encode():
                total += r._bits(c, byte)
                c = c[1:] + bytes([byte])
        return total + r._bits(c, 0x20)

    for token in ("m0r*n", "*1*6*", "p4th-et1c", "*|*|*"):
        best = min(itertools.product(*r.lattice(token)), key=cost)
        got = r.restore(token)
        same = [p for p in itertools.product(*r.lattice(token)) if "".join(x for x, _ in p) == got]
        assert min(map(cost, same)) == pytest.approx(cost(best))


# ---- kernels and pipeline --------------------------------------------------------------------------------------------------


def test_kernels(odd):
    import pyarrow as pa

    texts = [t for _, t in plain(odd)]
    col = pa.array(texts, pa.string())
    raw, off, null = textcore.buffers(col.slice(1))
    assert null.tolist() == [t is None for t in texts[1:]]
    start, end, first = textcore.words(raw, off)
    got = [bytes(raw[a:b]).decode() for a, b in zip(start, end, strict=True)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[1:]]
    assert got == [w for ws in want for w in ws] and np.diff(first).tolist() == [len(w) for w in want]
    h = textcore.word_hashes(raw, start, end)
    assert len(set(h.tolist())) == len({w for t in texts[1:] for w in words_of(t)})
    batch = pa.RecordBatch.from_arrays([col], names=["text"])
    assert sum(s.num_rows for s in textcore.slices(batch, "text", 100)) == len(texts)


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept, against brute force where there is one."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    bench = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
            old, new = dict(plain(before)), dict(plain(docs))
            assert new.keys() <= old.keys()
        else:
            old = dict(plain(before))
        if name == "quality_rules":
            assert new.keys() == {r["doc_id"] for r in quality.quality_rules(before).where("kept").collect()}
            fails = lambda t: (st := brute_stats(t))[0] < 50 or 100 * st[4] > 50 * st[0]
            assert not any(fails(t) for t in new.values()) and len(new) >= 0.9 * sum(not fails(t) for t in old.values())
        if name == "near_duplicates":
            classes = brute_classes(plain(before), 5, 80, 100)
            assert new.keys() == {c for _, c in classes.values()}
        if name == "repeated_passages":
            assert new == dict(brute_removals([(d, (t or "").encode()) for d, t in old.items()], 200, texts=True))
        if name == "decontamination":
            assert not any(b in t for t in new.values() for b in bench) and {d for d in old if d not in new} == {d for d, t in old.items() if any(b in t for b in bench)}
        if name == "packing":
            tok, pieces = Tokenizer.from_file(tokens.default_path()), collections.defaultdict(list)
            for r in docs.collect():
                pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
            assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {
                d: np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for d, t in old.items()
            }
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_pipeline_edges(spark, odd, empty, tmp_path):
    """Nulls, ties, long texts, clashing columns, an empty benchmark and empty documents go through all stages."""
    clash = odd.withColumns({c: F.lit("x") for c in ("_gone", "_kept", "_id", "_c", "kept", "unit", "cid", "copies", "text_", "rn")})
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    for name, docs, items in (("odd", clash, bench), ("bare", clash, bench.where("false")), ("empty", empty, bench)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}
        assert bool(out) == (name != "empty")
        for stage in corpus_pipeline.STAGES[:-1]:
            assert stage[1](spark, docs, f"{tmp_path}/{name}").columns == docs.columns


def test_toxicity_edges(toxic, odd):
    """Clashing columns, repeated rows and a very long text: a row for each row, equal rows with equal scores."""
    docs, labels = toxic
    model = toxicity.learn(docs, labels.withColumn("text", F.lit("clash")))
    long = docs.limit(1).select(F.lit(77).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("plain words "), 60_000), F.lit("m0r0n")).alias("text"))
    rows = odd.withColumns({"score": F.lit(5), "toxic": F.lit(1)}).unionByName(long, allowMissingColumns=True)
    out = toxicity.score(rows, model).collect()
    assert len(out) == rows.count() and all(0 <= r["score"] <= 1 for r in out)
    by_id = collections.defaultdict(set)
    for r in out:
        by_id[r["doc_id"]].add(r["score"])
    assert all(len(x) == 1 for x in by_id.values()) and min(by_id[77]) > max(by_id[1])


def test_decontamination_ignores_other_columns(spark, odd):
    docs = odd.withColumns({"item_id": F.lit(3), "words": F.lit("x")})
    bench = docs.select(F.col("doc_id").alias("item_id"), "text", F.lit("y").alias("doc_id")).where("length(text) < 2000")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert (6, 6) in found and (9, 6) in found and (8, 7) in found and not {d for d, _ in found} & {0, 1, 2, 3, 4}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and 6 not in {r["doc_id"] for r in kept.collect()}
