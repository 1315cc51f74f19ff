"""The ten operators against brute force, round trips and held-out accuracy, and on nulls, empties, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecast.llm import chat, decontaminate, jaccard_join, language_id, nearest, packing, queries, repeats, shared, substring_dedup, suffix_dedup, textscan, token_store, tokens, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def frame(spark, texts):
    """documents with a clashing extra column for every name that an operator might use."""
    rows = [(k, t, "en", "s", len(t or ""), 1, 2, "x", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, at long, key string, component_id long")


def empty(spark):
    return frame(spark, ["x"]).where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").orderBy("doc_id").collect()}


def near_copies(seed=0, groups=3, size=40, words=60):
    """Groups of copies with an edit or two each, exact copies, and strangers."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(30)]
    rng.shuffle(out)
    return out


ODD = [None, "", "   \t\n", "one", "one", "One", "two words", "a a a a a a a a a a a a", "é ü ß", "x" * 3000, "a\u00a0b c\x0bd", None, "", "🙂 🙂 🙂 🙂"]


def brute_components(texts, words, percent):
    sets = {}
    for k, t in enumerate(texts):
        w = WORD.findall(lower(t))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_components(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SHARD", 50)
    texts = near_copies() + ODD
    got = jaccard_join.jaccard_components(frame(spark, texts), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, words, percent)


def brute_links(texts, words, percent):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    first = {}
    for k, s in enumerate(sets):
        first.setdefault(s, k)
    near = [{b for b in range(len(sets)) if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])} for a in range(len(sets))]
    classes = {k: first[s] if s else k for k, s in enumerate(sets)}
    pairs = {(a, b) for a in set(classes.values()) for b in near[a] if a < b == classes[b]}
    return pairs, {k: (len(s), classes[k], len(near[k])) for k, s in enumerate(sets)}


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_links_are_all_there(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SHARD", 50)
    texts = near_copies(words=200) + ODD
    pairs, links = brute_links(texts, 3, 80)
    assert len(pairs) > 4 * len(texts)  # far more than each entry's two partners
    got = jaccard_join.class_links(frame(spark, texts), 3, 80).collect()
    assert len(got) == len(pairs) and {(r.u, r.v) for r in got} == pairs
    rows = jaccard_join.jaccard_links(frame(spark, texts), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.class_id, r.n_links) for r in rows} == links


def test_jaccard_links_empty_and_repeated(spark):
    assert jaccard_join.jaccard_links(empty(spark)).collect() == []
    assert jaccard_join.class_links(empty(spark)).collect() == []
    twice = frame(spark, ["a b c d e f", "z", "a b c d e f", None]).unionByName(frame(spark, ["a b c d e f", "z", "a b c d e f", None]))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_links(twice, 3, 90).collect())
    assert got == [(0, 0, 1)] * 2 + [(1, 1, 0)] * 2 + [(2, 0, 1)] * 2 + [(3, 3, 0)] * 2


def test_jaccard_empty_and_repeated(spark):
    assert jaccard_join.jaccard_components(empty(spark)).collect() == []
    twice = frame(spark, ["a b c d e f", "z"]).unionByName(frame(spark, ["a b c d e f", "z"]))
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(twice, 3, 90).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_jaccard_long_texts_use_wide_bitmaps(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(3000)]
    other = base[:]
    other[100], other[2000] = "x", "y"
    far = base[:1000] + [str(rng.randrange(10**6)) for _ in range(2000)]
    texts = [" ".join(t) for t in (base, other, far, base[:2900])]
    got = jaccard_join.jaccard_components(frame(spark, texts), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 0}


def brute_words(texts, window):
    first, out = {}, {}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), k) < k:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return out


def passages(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcd", k=rng.randint(1, 3))) for _ in range(50)]
    passage = rng.choices(vocabulary, k=90)
    out = []
    for k in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 120))
        if k % 3:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 20) : rng.randint(60, 90)]
        out.append(" ".join(body))
    return [*out, *out[:8], " ".join(["a"] * 200), " ".join(["a"] * 130), " ".join(["a", "b"] * 90), " ".join(["a", "b"] * 70), "  ".join(passage)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", 5000)
    texts = passages() + ODD
    got = substring_dedup.remove_repeats(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(texts, 50)


def test_substring_dedup_rewrites_documents(spark):
    texts = passages() + ODD
    docs = frame(spark, texts)
    got = substring_dedup.strip_repeats(docs)
    assert got.columns == docs.columns
    want = brute_words(texts, 50)
    for r in got.collect():
        if want[r.doc_id][1]:
            assert sha(r.text) == want[r.doc_id][2]
        else:
            assert r.text == texts[r.doc_id]
    assert substring_dedup.remove_repeats(empty(spark)).collect() == []


def test_recompression_gives_equal_interiors():
    rng = np.random.default_rng(1)
    core = rng.integers(1, 6, 50).astype(np.uint64)
    seen = set()
    for k in range(200):
        ends = [rng.integers(1, 6, rng.integers(0, 30)).astype(np.uint64) for _ in range(2)]
        text = np.concatenate([ends[0], core, ends[1]])
        start, symbol = substring_dedup.selected(text, np.array([0, len(text)]), 50)
        seen.add(int(symbol[list(start).index(len(ends[0]))]))
    assert len(seen) == 1


def brute_bytes(texts, length):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = passages() + ODD + ["é" * 150, "aé" * 100, "y" * 99, "y" * 100, "y" * 101]
    got = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(texts, 100)
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == []


def thue_morse(n, a="a", b="b"):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_patterns_on_which_sums_cancel(spark):
    """Words and windows that a hash which sums up weighted items takes for one another."""
    rng = random.Random(1)
    words = [rng.choices("abcdefghij", k=200) for _ in range(2)]
    pairs = [(thue_morse(2048), thue_morse(2048, "b", "a")), (thue_morse(256), thue_morse(256, "b", "a"))]
    texts = [" ".join([*some, word]) for one, other in pairs for some, word in ((words[0][:80], one), (words[1][:80], other))]
    texts = [one for pair in pairs for one in (" ".join(["x", *["y"] * 20, pair[0], *["z"] * 40]), " ".join(["x", *["y"] * 20, pair[1], *["z"] * 40]))] + texts
    texts += [" ".join(thue_morse(4096)), " ".join(thue_morse(4096, "b", "a"))[:4100]]
    got = substring_dedup.remove_repeats(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(texts, 50)
    got = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(texts, 100)
    got = jaccard_join.jaccard_components(frame(spark, texts), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 90)


@pytest.mark.parametrize(("length", "have"), [(1, 1), (3, 1), (50, 1), (7, 7), (8, 8), (20, 8), (100, 8)])
def test_refined_buckets_are_equal_runs(length, have):
    rng = np.random.default_rng(length)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in rng.integers(length, length + 60, 30)]
    parts += [parts[3], parts[4][: length + 1], np.full(length + 40, 97, np.uint8)]
    size = np.array([len(p) for p in parts])
    data = np.concatenate(parts)
    codes = data.astype(np.int64) if have == 1 else textscan.eights(data)[: len(data)] & textscan.MASK[have]
    got = repeats.same_runs(codes, size, length, have)
    want = [p[k : k + length].tobytes() for p in parts for k in range(len(p) - length + 1)]
    assert len(got) == len(want)
    assert len({(g, w) for g, w in zip(got.tolist(), want, strict=True)}) == len(set(got.tolist())) == len(set(want))


def test_rows_that_repeat_a_doc_id_do_not_break_dedup(spark):
    docs = frame(spark, [" ".join(map(str, range(200)))] * 2)
    both = docs.unionByName(frame(spark, ["short"]))
    assert substring_dedup.remove_repeats(both).count() == 3
    assert suffix_dedup.remove_repeats(both).count() == 3


def brute_contamination(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, t in items:
        w = pattern.findall(lower(t))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(item)
    out = {}
    for k, t in enumerate(texts):
        w = pattern.findall(lower(t))
        hit, found = [0] * len(w), set()
        for n in set(map(len, windows)):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [1] * n
        out[k] = (len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), sum(hit) > 0)
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)] + ["the"] * 20
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 10, 14, 30])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1]), (103, "!!!"), (7, items[7][1])]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    texts += [f"{a}. {(items[k % 25][1] or '').upper()}! {b}" for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False))] + ODD
    benchmark = spark.createDataFrame([(k, t, 9) for k, t in items], "item_id long, text string, win long")
    got = decontaminate.contamination(frame(spark, texts), benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute_contamination(texts, items)


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, ["a b", None]), none).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(2, 0, 0, False), (0, 0, 0, False)]
    assert decontaminate.contamination(empty(spark), none).collect() == []


def reference_ids(name, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


STRANGE = [*ODD, "It's  two   spaces\t\ttabs\n\n\nlines \n x", "don't DON'T we'll", "<|endoftext|> a<|startoftext|>b", "1234 5,678.90", "İSTANBUL Σίσυφος ΟΔΟΣ", "e\u0301 \u200b zero\u00adwidth", "...!!??--", "日本語 テスト", "a\x1cb\x85c", " lead", "trail ", "\0nul", "_a_b_ c.d,e", "\u2028 \u3000x"]


@pytest.mark.parametrize(("make", "name"), [(lambda: tokens.ByteEncoder(), "byte_bpe_50k.json"), (lambda: tokens.Encoder(), "word_bpe_49k.json")])
def test_encoders_agree_with_the_library(make, name):
    encoder = make()
    texts = [t or "" for t in STRANGE]
    for some in (texts, texts[::-1], [" ".join(texts)]):
        ids, total = encoder.encode(some)
        for k, t in enumerate(some):
            assert ids[total[k] : total[k + 1]].tolist() == reference_ids(name, t), t


@pytest.mark.parametrize("text", ["_word_.", "a_,b", "foo._bar", "see snake_, then", "x ,_y", "a_b. c_d, e"])
def test_an_underscore_is_a_sign(text):
    ids, _ = tokens.Encoder().encode([text])
    assert ids.tolist() == reference_ids("word_bpe_49k.json", text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encoder = tokens.Encoder()
    for t in ("a b c d e f", "g h i", "a z"):
        ids, _ = encoder.encode([t])
        assert ids.tolist() == reference_ids("word_bpe_49k.json", t)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20)
    texts = [*STRANGE, "w " * 3000, *(f"{'tok ' * k}" for k in range(0, 900, 37)), "a " * 1023, "a " * 1024]
    rows = packing.pack_documents(frame(spark, texts), 1024).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(texts):
        ids = reference_ids("byte_bpe_50k.json", t)
        at = 0
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], np.uint32).tobytes())
            at += r.length
        assert at == len(ids) and (len(by_doc[k]) == 1 or len(ids) > 1024)
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty(spark)).collect() == []


def test_sum_of_squares_is_close_to_the_bound():
    sizes = np.sort(np.random.default_rng(4).integers(1, 1024, 20_000))[::-1]
    bins, offsets = packing.place(sizes, 1024)
    assert bins.max() + 1 <= 1.01 * -(-sizes.sum() // 1024)
    ends = np.zeros(bins.max() + 1, int)
    np.maximum.at(ends, bins, offsets + sizes)
    assert ends.max() <= 1024


def test_chat_round_trip():
    rng = random.Random(1)
    parts = ["\\", "<", "#", "</turn>", "### ", "assistant: ", "\n", " ", "a", "é", "n", ";", ":", " </turn>\n"]
    for _ in range(1500):
        turns = [(rng.choice(["system", "user", "assistant", "x:\n", "a\\n", "\\", ""]), "".join(rng.choices(parts, k=rng.randint(0, 60)))) for _ in range(rng.randint(1, 9))]
        windows = chat.format_conversation([r for r, _ in turns], [t for _, t in turns], rng.choice([5, 30, 100]), rng.choice([0, 10, 40]))
        read, loss = chat.read_conversation(windows)
        assert read == turns
        assert loss == "".join(t for r, t in turns if r == "assistant")


def test_chat_windows_keep_the_budget():
    turns = [("system", "be brief"), *[(r, "w " * 20) for _ in range(20) for r in ("user", "assistant")]]
    windows = chat.format_conversation([r for r, _ in turns], [t for _, t in turns], 120, 50)
    assert len(windows) > 5
    for k, w in enumerate(windows):
        assert chat.count_tokens(w["text"]) <= 120
        assert chat.read_turns(w["text"])[0] == ("system", "be brief")
        assert not k or w["repeated"] >= 1


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op4_chat_formatting(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    text = "\\### Assistant: </turn> ok"
    turns = collections.defaultdict(list, {-7: [("user", text), ("assistant", text)]})
    for r in rows:
        turns[r.conv_id].append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for k, found in turns.items():
        loss = "".join(t for r, t in found if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(found), sha("".join(f"{r}\n{t}\n" for r, t in found)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))


def test_chat_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 5), (1, 0, None, None, 5), (2, 0, "assistant", "", 5)], "conv_id long, turn long, role string, text string, window int")
    got = {r.conv_id: r for r in chat.digests(chat.windows(rows)).collect()}
    assert (got[1].n_turns, got[2].n_turns, got[2].loss_chars) == (2, 1, 0)
    assert chat.digests(chat.windows(rows.where("false"))).collect() == []


def test_token_store(spark, tmp_path):
    texts = [*STRANGE, "the cat sat " * 500, *["the cat sat on the mat"] * 30]
    path = f"file://{tmp_path}/ids"
    got = {r.doc_id: r for r in token_store.store_and_read(frame(spark, texts), path).collect()}
    at = 0
    for k, t in enumerate(texts):
        ids = reference_ids("word_bpe_49k.json", t)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        at += len(ids)
    for row in spark.read.parquet(path).collect():
        block = token_store.Block(bytes(row.payload))
        for n, doc in enumerate(block.docs.tolist()):
            ids = reference_ids("word_bpe_49k.json", texts[doc])
            assert block.document(n).tolist() == ids
            assert block.document(n, 3, 17).tolist() == ids[3:17]
            assert block.document(n, len(ids), len(ids) + 5).tolist() == []
    assert token_store.store_and_read(empty(spark), f"file://{tmp_path}/none").collect() == []


def test_token_store_keeps_repeated_rows_of_several_blocks(spark, tmp_path):
    long = "the cat sat " * 150_000  # more than a block
    twice = frame(spark, ["one", long, "two"]).unionByName(frame(spark, ["one", long, "two"]))
    rows = token_store.store_and_read(twice, f"file://{tmp_path}/ids").orderBy("start").collect()
    ids = [reference_ids("word_bpe_49k.json", t) for t in ("one", "one", long, long, "two", "two")]
    assert [r.doc_id for r in rows] == [0, 0, 1, 1, 2, 2]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(i), zlib.crc32(np.array(i, np.uint32).tobytes())) for i in ids]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([len(i) for i in ids])])[:-1].tolist()


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op8", "op9", "op10"])
def test_rows_without_an_id_take_no_part(spark, name):
    texts = ["some words that are said here again and again " * 12, "some words that are said here again and again " * 12, "z", None]
    docs = frame(spark, texts)
    more = docs.unionByName(frame(spark, [texts[0], None, "new words"]).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(0, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "again and again some words"), (None, "z")], "item_id long, text string")
    run = {
        "op1": lambda d: jaccard_join.jaccard_components(d, 3, 90),
        "op2": suffix_dedup.remove_repeats,
        "op3": lambda d: packing.pack_documents(d).drop("sequence_id", "offset"),
        "op5": token_store.store_and_read,
        "op6": lambda d: decontaminate.contamination(d, items),
        "op8": language_id.language_id,
        "op9": substring_dedup.remove_repeats,
        "op10": lambda d: toxicity.toxicity(d, labels),
    }[name]
    got = sorted(map(str, run(more).collect()))
    assert got and got == sorted(map(str, run(docs).collect()))


def test_language_id_learns_from_the_text_beside_the_lang(spark):
    one, other = "the cat sat on the mat and the dog ran " * 5, "der hund lief und die katze schlief auf der decke " * 5
    rows = [(k, (one, other)[k % 2], ("en", "de")[k % 2]) for k in range(60)] + [(k, (other, one)[k % 2], ("de", "en")[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.language_id(docs)
    assert found.count() == 120
    texts = docs.select("doc_id").distinct().count()
    assert texts == 60 and found.groupBy("lang_pred").count().orderBy("lang_pred").collect() == [("de", 60), ("en", 60)]


def test_repair_shrinks_and_restores():
    rng = np.random.default_rng(0)
    ids = rng.choice(np.array([5, 6, 7, 8, 40_000], np.uint32), 20_000, p=[0.4, 0.3, 0.2, 0.05, 0.05])
    first = np.array([0, 0, 1, 5000, 5000, 19_999, 20_000])
    block = token_store.Block(token_store.write_block(np.arange(6), ids, first))
    assert len(block.symbols) < len(ids) / 2 and len(block.rules)
    assert (block.ids() == ids).all()
    for k in range(6):
        assert (block.document(k) == ids[first[k] : first[k + 1]]).all()


@pytest.mark.parametrize("kind", ["phrases", "one id", "random"])
def test_repair_goes_on_until_no_pair_is_frequent(kind):
    rng = np.random.default_rng(2)
    phrases = rng.integers(3, 49_000, (12, 40))
    ids = {"phrases": phrases[rng.integers(0, 12, 500)].ravel(), "one id": np.full(20_000, 7), "random": rng.integers(3, 60, 20_000)}[kind].astype(np.uint32)
    first = np.array([0, 1, 7000, 7000, len(ids)])
    block = token_store.Block(token_store.write_block(np.arange(4), ids, first))
    for k in range(4):
        assert (block.document(k) == ids[first[k] : first[k + 1]]).all()
    left = collections.Counter()
    for a, b in zip(block.at[:-1], block.at[1:], strict=True):
        own = block.symbols[a:b].tolist()
        left.update(zip(own[:-1], own[1:], strict=True))
    assert max(left.values(), default=0) < token_store.LEAST
    if kind != "random":
        assert block.length.max() >= 40


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 6000)] + rng.normal(scale=0.4, size=(6000, 16))) * rng.uniform(0.5, 2, (6000, 1))
    vectors[100:1100] = vectors[100]  # a large group of copies
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.search(rows, rows.where("vec_id % 50 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 6000, 50):
        scores = vectors @ vectors[q]
        order = [int(k) for k in np.lexsort((np.arange(6000), -np.round(scores, 9))) if k != q][:20]
        assert len(got[q]) == 20
        assert all(abs(s - scores[v]) < 1e-9 for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-round(x[1], 12), x[0]))
        hit += len({v for v, _ in got[q]} & set(order))
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("sigma", [0.5, 1.5])
def test_nearest_recall_among_very_different_lengths(spark, monkeypatch, sigma):
    monkeypatch.setattr(nearest, "PER_LIST", 32)  # 188 lists, more than the beam looks through at once
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    vectors = centres[rng.integers(0, 40, 6000)] + rng.normal(scale=0.5, size=(6000, 32))
    vectors *= rng.lognormal(0, sigma, (6000, 1)) / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nearest.search(rows, rows.where("vec_id % 50 = 0"), 20).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 50):
        hit += len(got[q] & set([int(k) for k in np.argsort(-(vectors @ vectors[q])) if k != q][:20]))
    assert hit / (120 * 20) >= 0.9


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = nearest.search(table, table, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (1, 1, 0, 1.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]
    assert nearest.search(table.where("false"), table.where("false")).collect() == []


def test_nearest_with_split_lists_and_many_equal_queries(spark, monkeypatch):
    for name, value in (("PER_LIST", 40), ("LIST_MOST", 15), ("QUERY_MOST", 7), ("LEAST_LISTS", 100), ("MOST_BEAM", 100)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 8))
    vectors[50:250] = vectors[50]  # half of all queries are equal, and so are half of all candidates
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.search(rows, rows, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    exact = {v: np.einsum("ij,ij->i", np.repeat(vectors[v][None], 400, 0), vectors) for v in range(400)}
    for q in range(400):
        order = [int(v) for v in np.lexsort((np.arange(400), -exact[q])) if v != q][:20]
        assert [v for v, _, _ in got[q]] == order and [k for _, _, k in got[q]] == list(range(1, 21))
        assert all(abs(s - exact[q][v]) < 1e-12 for v, s, _ in got[q])


def test_bundles_are_what_binding_letter_by_letter_gives():
    texts = ["Ab c!", "the cat, the CAT", "é", "x1y  zz"]
    letters = language_id._letters().astype(float)
    got, has = language_id.profiles(texts)
    for k, text in enumerate(texts):
        marked = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        slots = [0 if c == " " else ord(c) % (language_id.SLOTS - 1) + 1 for c in marked]
        counts = collections.Counter(tuple(slots[i : i + 3]) for i in range(len(slots) - 2) if slots[i + 1])
        bundle = sum(np.sqrt(n) * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for (a, b, c), n in counts.items())
        assert has[k] and np.allclose(got[k], bundle / np.linalg.norm(bundle), atol=1e-5)


def test_scores_are_the_softmax_of_the_mean_of_subwords():
    rng = np.random.default_rng(6)
    scalars, bias = rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.3
    texts = ["one word", "one one two, three", "", "Ünïcödé WORDS words", "a"]
    buckets, weights = toxicity.bags(toxicity.pa.array(texts))
    want = [1 / (1 + np.exp(-(float((scalars[b].astype(float) * w).sum()) + bias))) for b, w in zip(buckets, weights, strict=True)]
    data = "".join(texts).encode()
    cuts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    part = textscan.Texts(np.arange(len(texts)), np.frombuffer(data, np.uint8), cuts)
    assert np.allclose(toxicity._scores(part, (scalars, bias)), want, atol=1e-5)


def test_language_id(spark, documents):
    got = language_id.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_odd_texts(spark):
    docs = frame(spark, [*ODD, "123 !!"])
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    for k, t in enumerate([*ODD, "123 !!"]):
        assert (got[k].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    none = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language_id.language_id(empty(spark)).collect() == []


def test_toxicity_learns_subwords(spark):
    rng = random.Random(9)
    clean = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 9))) for _ in range(400)]
    bad = ["scumbag", "worthless", "pathetic"]
    texts, labels = [], []
    for k in range(1500):
        words = rng.choices(clean, k=rng.randint(10, 80))
        if k % 4 == 0:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((k, 1, int(k % 4 == 0)))
    texts += [f"{' '.join(rng.choices(clean, k=12))} {w}" for w in ("scumbagg", "worthles", "patheticc")]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [k for k in range(1500) if got[k].held_out]
    assert sum(got[k].predicted == int(k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert sum(got[1500 + k].predicted for k in range(3)) >= 2  # unseen misspellings


def test_toxicity_odd_inputs(spark):
    docs = frame(spark, ODD)
    labels = "doc_id long, quality int, toxic int"
    none = toxicity.toxicity(docs, spark.createDataFrame([], labels)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    nulls = spark.createDataFrame([(3, None, None), (4, 1, 1), (4, 1, 0)], labels)
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, nulls).collect())
    assert toxicity.toxicity(empty(spark), nulls).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (7, 7)], "a long, b long"))
    got = {r.node: r.component for r in shared.components(links).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert shared.components(links.where("false")).collect() == []


def test_queries_are_registered_once_for_each_operator():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def test_index_lists_are_cut_where_sizes_cannot_link(spark):
    rows = [(k, n, [7], bytes(32), 100 + k) for k, n in enumerate([10, 11, 13, 40, 100, 101, 102, 110, 300])] + [(20, 50, [8], bytes(32), 200), (21, 90, [8], bytes(32), 201)]
    entries = spark.createDataFrame(rows, "doc_id long, n long, prefix array<long>, bits binary, gid long")
    lists = {}
    for r in jaccard_join._lists(entries, 80).collect():
        lists.setdefault((r["list"], r["many"], r["most"], r["weight"]), set()).add((r["gid"], r["n"]))
    assert sorted(map(sorted, lists.values())) == [[(100, 10), (101, 11), (102, 13)], [(104, 100), (105, 101), (106, 102), (107, 110)]]
    assert sorted(k[1:] for k in lists) == [(3, 1, 1), (4, 1, 1)]


def test_texts_that_lose_no_words_are_not_shuffled_to_meet_marks(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, passage), (2, f"x {passage} y"), (3, "a  b"), (4, None), (None, passage)], "doc_id long, text string")
    got = substring_dedup.strip_repeats(docs)
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, passage), (2, "x y"), (3, "a  b"), (4, None), (None, passage)]))


def mixed(rng, own, passage=""):
    """Words of a small vocabulary around words of the text's own and a passage."""
    words = [f"c{rng.randrange(40)}" for _ in range(100)]
    for k in range(30):
        words.insert(rng.randrange(len(words)), f"{own}x{k}")
    return f"{' '.join(words)} {passage}"


def test_shingles_that_texts_share_by_chance_stay_out_of_the_index(spark):
    rng = random.Random(11)
    docs = frame(spark, [mixed(rng, f"d{k}") for k in range(200)])
    _, _, entries = jaccard_join._classes(docs, 3, 90, "doc_id", "text")
    assert entries.count() == 200 and jaccard_join._lists(entries, 90).count() == 0


def test_the_last_round_reads_no_long_list_without_partners(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(12))
    texts = [mixed(rng, f"d{k}", passage) for k in range(5)] + [mixed(rng, f"d{k}") for k in range(5, 200)]
    seen, long = [], jaccard_join._long
    monkeypatch.setattr(jaccard_join, "_long", lambda lists, members, rows, percent, every: seen.append((rows, every)) or long(lists, members, rows, percent, every))
    got = jaccard_join.jaccard_components(frame(spark, texts), 3, 90).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert seen[0][0] >= 5 and not seen[0][1] and seen[-1] == (0, True)


def _shard_of_near_copies(lists, copies):
    """A shard in which a group of near copies is alone in lists, and the partners that the bounds leave: {(u, v): far}."""
    rng = np.random.default_rng(13)
    bits = np.tile(rng.integers(0, 1 << 63, 4, dtype=np.uint64), (copies, 1))
    bits[np.arange(copies), rng.integers(0, 4, copies)] ^= rng.integers(0, 1 << 20, copies, dtype=np.uint64)
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2).astype(int)
    near = {(u, v): far[u, v] for u in range(copies) for v in range(copies) if u != v and far[u, v] <= 200 - 2 * -(-80 * 200 // 180)}
    zero, same = np.zeros(lists, np.int64), np.full(lists, 7, np.int64)
    table = jaccard_join.pa.table({"list": np.arange(lists), "b1": zero, "b2": zero, "block": zero, "gid": same, "n": same - 7 + 100})
    doc = np.arange(copies)
    members = jaccard_join.pa.table({"group": np.full(copies, 7), "doc": doc, "comp": doc, "size": np.full(copies, 100), "bits": [r.tobytes() for r in bits]})
    return table, members, near


@pytest.mark.parametrize("every", [False, True])
def test_a_group_of_near_copies_meets_in_little_memory(every):
    import tracemalloc

    lists, members, near = _shard_of_near_copies(40, 300)
    tracemalloc.start()
    got = jaccard_join._meet(lists, members, 80, every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    if every:
        want = {(u, v, far) for (u, v), far in near.items() if u < v}
    else:
        of = collections.defaultdict(list)
        for (u, v), far in near.items():
            of[u].append((far, v))
        want = {(u, v, far) for u, found in of.items() for far, v in (min(found), min(found, key=lambda p: p[1]), max(found, key=lambda p: p[1]))}
    rows = list(zip(*(got.column(c).to_pylist() for c in ("u", "v", "far")), strict=True))
    assert len(near) > 40_000 and len(rows) == len(want) and set(rows) == want
    assert peak < 40e6  # 40 lists come to 1.8 million pairs, of 45,000 different ones
