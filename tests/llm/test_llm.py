"""Operators against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from framewright.llm import bpe, jaccard, pretokens, repeats, sharding, token_counts, token_files, toxicity, warc
from framewright.llm.token_counts import tokenizer

SCHEMA = "doc_id long, text string, key string, n long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(40)]
    texts += [t.replace(" ", "  ", 1) + " Tail" for t in texts[:8]] + texts[:5] + [texts[3] + texts[9], "x" * 3000, "ab" * 900]
    return [(i, t, "k", 1) for i, t in enumerate([None, "", "  \n", *texts])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(docs, none, rows):
    got = sharding.shard_by_size(docs).collect()
    assert len(got) == len(rows) and sharding.shard_by_size(none).count() == 0
    text = {i: t or "" for i, t, *_ in rows}
    place = {}
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and place.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r.shard == s)
        assert mine == list(range(len(mine)))


def test_token_counts_and_splices(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = {i: len(tokenizer(path).encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == want
    assert token_counts.token_counts(none, path).count() == 0
    long = " ".join(t or "" for _, t, *_ in rows)
    whole = tokenizer(path).encode(long, add_special_tokens=False)
    assert [i for i, _ in token_counts.encode_spliced(tokenizer(path), long, 4096, 256)] == whole.ids


def test_words_are_counted_once():
    """Remembered words give the library's counts, whatever parts them, and no word is encoded twice."""
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.parted(path) and not token_counts.parted(public_tokenizers.path("byte_bpe_50k.json"))
    t, encoded = tokenizer(path), []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            encoded.extend(texts)
            return t.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(t, name)

    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    words = ["it's", "IT'S", "ΣΑΣ", "İx", "e\u0301", "\u0301a", "x\u0323\u0307", "--don't--", "a1b22", "½²", "日本語", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "<|end", "oftext|>", "\ud55c", "\u1112\u1161\u11ab", "\U0001f600!", "\0", "x" * 300]
    texts = [s.join(words) + s for s in spaces] + [a + b for a in words for b in words] + [" ".join(words) * 2, "", " "]
    known = {}
    for _ in range(2):
        assert token_counts.count_texts(Counting(), texts, known) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    own = [w for w in encoded if len(w) <= token_counts.LONG and not token_counts.UNPARTED.search(w)]
    assert own and len(own) == len(set(own)) and "it's" in known and "x" * 300 not in known


def test_token_files(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs, path).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = np.array([*tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(none, path).count() == 0


def test_latin_pattern_gives_the_same_matches():
    plain = [c for c in map(chr, range(0x2070)) if pretokens.plain(c)]
    assert sum(pretokens.BEYOND.search(c) is None for c in plain) > 600
    for c in plain:
        for x in (c, f"a{c}b", f" {c}1 {c} {c}{c}_", f"é{c} ½"):
            assert pretokens.matches(x) == (pretokens.FAST.findall(x) if pretokens.plain(x) else None)
    assert pretokens.matches("x²") is None and pretokens.matches("日") is None


@pytest.mark.parametrize("remembered", [900_000, 40])
def test_word_ids_are_the_library_s(monkeypatch, remembered):
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    t = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    known = token_files.WordIds(t, "<u2")
    known.ids, known.starts, known.sizes = known.ids[:3], known.starts[:2], known.sizes[:2]
    texts = ["", "Straße, λόγος x² don't", " a  b\n\n c\t", "<|endoftext|> y", "日本 語", "a\n\nb \n c\n d  e\u00a0f\x01g\n", "it's 'll\x0b1\x85_2", "\n x", *(f"w{i} word{i}, $$$ {i}!" for i in range(60))]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        assert [np.frombuffer(x, "<u2").tolist() for x in known.encode(part)] == [t.encode(x, add_special_tokens=False).ids for x in part]
    assert isinstance(known.ids, np.ndarray) and known.encode([]) == []


def test_warc(spark):
    inner = warc.record(9, "u", b"inner", "0", None).decode("latin-1")
    pages = [(1, None, "a" * 1000, 0), (2, "u", "a" * 1000, 0), (3, "u\r\nX: y", "b", 0), (4, "u", "b", 0), (5, "u", None, 0), (6, "u", inner + "WARC/1.1\r\n", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    for p, _, html, _ in pages:
        raw = (html or "").encode()
        assert got[p] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if p == 1 else "response", 2 if p == 1 else None)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_null_ids_have_a_place(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(None, "a word"), (3, "three"), (None, None), (0, "none"), (-5, "less"), *((None, f"no {i}") for i in range(6))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for size in (2000, 2):
        got = token_files.read_digests(*token_files.write_files(docs, path, rows_a_file=size)).orderBy("start").collect()
        crc = lambda t: zlib.crc32(np.array([*tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
        assert [r.doc_id for r in got] == [None] * 8 + [-5, 0, 3]
        assert sorted(r.ids_crc32 for r in got[:8]) == sorted(crc(t) for i, t in texts if i is None)
        assert [r.ids_crc32 for r in got[8:]] == [crc("less"), crc("none"), crc("three")]
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    only = docs.filter("doc_id is null")
    assert token_files.round_trip(only, path).filter("doc_id is null").count() == 8
    pages = [(None, "u", "a" * 1000), (None, "u", "a" * 1000), (1, "u", "a" * 1000), (2, "u", "a" * 1000), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    home, manifest = warc.write(df)
    assert len({r.headers["warc-record-id"] for r in warc.read(spark, home, manifest).collect()}) == 5
    found = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    assert sorted(found, key=str) == sorted([(1, 1000, "revisit", 2), (2, 1000, "response", None), (None, 0, "response", None), *[(None, 1000, "response", None)] * 2], key=str)


def test_chains_reject_what_is_not_reached():
    assert warc.reachable(np.array([0, 5, 10, 12]), np.array([10, 10, 20, 20])).tolist() == [True, False, True, False]
    assert warc.reachable(np.array([3]), np.array([9])).tolist() == [False]


def test_byte_bpe(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_label_model_and_classifier():
    """Voters of known accuracy: posteriors near the true ones, weights at the least of the penalised loss; copies of a voter share its weight."""
    r = np.random.default_rng(2)
    y = r.random(60_000) < 0.1
    votes = np.zeros((len(y), toxicity.LEXICONS + 3), np.int64)
    for v in range(3):
        votes[:, v] = np.where(y, r.random(len(y)) < 0.7, r.random(len(y)) < 0.03)
    votes[:, 3] = votes[:, 0]
    label = np.where(r.random(len(y)) < 0.3, y.astype(int), -1)
    packed = (votes[:, : toxicity.LEXICONS] << np.arange(0, 2 * toxicity.LEXICONS, 2)).sum(1)
    kinds, count = np.unique(np.stack([packed, label], 1), axis=0, return_counts=True)
    model = toxicity.label_model(toxicity.unpacked(kinds[:, 0]), count.astype(float), kinds[:, 1])
    of = {tuple(k): q for k, q in zip(kinds, model["posterior"])}
    for pattern in range(8):
        bits = [pattern >> i & 1 for i in range(3)]
        odds = 0.1 / 0.9 * np.prod([0.7 / 0.03 if b else 0.3 / 0.97 for b in bits])
        true, found = odds / (1 + odds), of.get((sum(b << 2 * i for i, b in enumerate([*bits, bits[0]])), -1))
        assert found is None or (found > 0.5) == (true > 0.5) or abs(true - 0.5) < 0.2, (bits, true, found)
    # The copied voter and its copy have about half a weight each, the others a whole one.
    assert max(model["weight"][0], model["weight"][3]) < 0.62 < 0.85 < min(model["weight"][1], model["weight"][2])
    x, q, w = r.random((500, 4)), r.random(500), r.random(500) * 5
    b = toxicity.fit_linear(x, q, w, ridge=0.7)
    full = np.hstack([x, np.ones((500, 1))])
    assert np.abs(full.T @ (w * (q - 1 / (1 + np.exp(-full @ b)))) - 0.7 * b).max() < 1e-6


def test_folds_never_see_held_out_rows(spark):
    r = random.Random(9)
    rows = [(i, " ".join([*(r.choice(["one", "two", "three", "four"]) for _ in range(12)), *(["vile", "rotten"] if i % 6 == 0 else [])])) for i in range(400)]
    labels = [(i, int(i % 6 == 0)) for i in range(400)]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    settings = [{"absent": 0.5}, {"absent": 1.0, "label_rates": (0.9, 0.05)}]
    kind = "doc_id long, text string"
    every = toxicity.fold_errors(spark.createDataFrame(rows, kind), spark.createDataFrame(labels, "doc_id long, toxic int"), settings)
    wrong = [(i, "vile rotten" if out(i) else t) for i, t in rows], [(i, 1 - y if out(i) else y) for i, y in labels]
    assert toxicity.fold_errors(spark.createDataFrame(wrong[0], kind), spark.createDataFrame(wrong[1], "doc_id long, toxic int"), settings) == every
    assert every[0][:2] == (0, 0)


def test_toxicity_on_odd_tables(spark):
    kind, named = "doc_id long, text string, votes long, held_out int", "doc_id long, toxic int, votes int"
    rows = [(1, "a b", 1, 1), (1, "a b", 1, 1), (None, "c", 1, 1), (2, None, None, None)]
    for labels in ([], [(1, 1, 1), (1, 0, 1), (None, 1, None), (2, None, None)]):
        got = toxicity.scored(spark.createDataFrame(rows, kind), spark.createDataFrame(labels, named))
        assert sorted(map(str, (x.doc_id for x in got.collect()))) == ["1", "1", "2", "None"] and len({x.score for x in got.filter("doc_id = 1").collect()}) == 1
        assert toxicity.scored(spark.createDataFrame([], kind), spark.createDataFrame(labels, named)).count() == 0


def test_runs_of_equal_groups_are_as_the_heap_deals_them():
    """The closed form against a plain heap: ties, levels that are not reached, long runs."""
    import heapq

    r = random.Random(8)
    for _ in range(400):
        loads = [r.randint(0, r.choice([0, 5, 300])) for _ in range(r.randint(1, 9))]
        size, count = r.randint(1, 40), r.choice([0, 1, 7, 8 * len(loads), 8 * len(loads) + 1, 1000])
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        want = [0] * len(loads)
        for _ in range(count):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            want[i] += 1
        mine = list(loads)
        assert sharding.spread_run(mine, size, count) == want and mine == [a + size * n for a, n in zip(loads, want)]


def test_shards_are_those_of_one_heap_over_all_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_A_RUN", 50)
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.choice([2, 7, 8, 9, 60])))) for i in range(900)]
    got = sharding.shard_by_size(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t) + 1
    loads = [0] * 7
    for size in sorted(groups.values(), reverse=True):
        at = loads.index(min(loads))
        loads[at] += size
    mine = [sum(x["size"] for x in got if x.shard == s) for s in range(7)]
    assert mine == loads


def test_null_ids_take_the_component_of_their_text(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t), (None, t), (None, t + " x"), (None, "quite another text of words"), (None, None)]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (0, 27, 1), (0, 28, 0), (1, 27, 1)]


def test_toxicity(spark):
    r = random.Random(3)
    bad, rest = ["vile", "rotten", "nasty"], ["one", "two", "three", "four", "five"]
    text = lambda toxic: " ".join(r.choice(rest) for _ in range(20)) + (" " + " ".join(r.sample(bad, 2)) if toxic else "")
    rows = [(i, text(i % 6 == 0)) for i in range(600)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.scored(docs, labels).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert sum(got[i].predicted == int(i % 6 == 0) for i in range(600)) >= 594
    assert got[1000].predicted == got[1001].predicted == 0


def test_toxicity_rare_words(spark):
    """Words and stems far rarer than the most frequent ones vote too; a single word of a stem is no alarm."""
    r = random.Random(4)
    ends = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    clean = lambda: " ".join(word() for _ in range(25))
    kinds, rows = {}, []
    for i in range(3000):
        k = kinds[i] = "common" if i % 10 == 0 else "rare" if i % 50 == 1 else "stem" if i % 50 == 2 else "once" if i % 50 == 3 else "clean"
        more = {"common": ["vile", "nasty"], "rare": ["ekelhaft"], "stem": ["xuzq" + e for e in r.sample(ends, 4)], "once": ["xuzq" + r.choice(ends)]}.get(k, [])
        rows.append((i, " ".join([clean(), *more])))
    toxic = {i: int(k in ("common", "rare", "stem")) for i, k in kinds.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.scored(docs, labels).collect() if x.held_out}
    for kind in ("common", "rare", "stem", "once", "clean"):
        own = [got[i] for i in got if kinds[i] == kind]
        assert own and (sum(own) >= 0.8 * len(own) if kind in ("common", "rare", "stem") else sum(own) <= 0.1 * len(own)), (kind, sum(own), len(own))


def test_toxic_rows_without_doc_id_go(spark):
    r = random.Random(6)
    text = lambda bad: " ".join([*(r.choice(["one", "two", "three", "four"]) for _ in range(20)), *(["vile", "rotten"] if bad else [])])
    rows = [(i, text(i % 6 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (None, text(True)), (None, text(False)), (None, None)], "doc_id long, text string")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((x.text or "").count("vile") for x in kept.collect() if x.doc_id is None) == [0, 0]
    assert {x.doc_id for x in kept.collect()} == {None, *(i for i, _ in rows if i % 6)}


def test_jaccard(docs, none, rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    assert jaccard.classes(none).count() == 0


def test_deduplicated_keeps_one_row_of_each_class(spark):
    r = random.Random(5)
    long = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(90))
    same, copy, lone, first, second = (long() for _ in range(5))
    rows = [(1, same), (1, same), (2, same), (None, same), (3, copy), (None, copy + " tail"), (None, copy), (None, lone), (None, lone), (5, first), (5, second), (6, second)]
    rows += [(None, None), (None, ""), (7, " "), (7, " "), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.deduplicated(docs)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = [(1, same), (3, copy), (None, lone), (5, min(first, second)), (None, None), (None, ""), (7, " "), (7, " "), (6, "")]
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)
    assert sorted((x.text for x in repeats.without_repeats(kept).collect() if x.text and x.text.strip())) == sorted(t for _, t in want if t and t.strip())



@pytest.mark.parametrize("group", [1_000_000, 20_000, 1])
def test_repeats(docs, none, rows, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    count = {}
    for x in raw.values():
        for j in range(len(x) - 399):
            count[x[j : j + 400]] = count.get(x[j : j + 400], 0) + 1
    got = {r.doc_id: tuple(r)[1:] for r in repeats.report(docs).collect()}
    for i, x in raw.items():
        gone = [False] * len(x)
        for j in range(len(x) - 399):
            if count[x[j : j + 400]] > 1:
                gone[j : j + 400] = [True] * 400
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        assert got[i] == (len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i
    assert repeats.report(none).count() == 0


def test_a_word_longer_than_a_piece_is_one_word(monkeypatch):
    from framewright.llm import shingles

    texts = ["a bb " + "x" * 5_000 + " c dd", "y" * 3_000, " " * 900 + "z", "one " * 700 + "w" * 900]
    want = [shingles.word_hashes(t.encode()).tolist() for t in texts]
    monkeypatch.setattr(shingles, "AT_ONCE", 256)
    assert [shingles.word_hashes(t.encode()).tolist() for t in texts] == want


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_jaccard_on_edited_copies(spark, percent):
    """Copies of a base with more and more words changed, so that many pairs lie about the threshold."""
    r = random.Random(percent)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.randint(30, 80))]
        for _ in range(25):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(0, 6)):
                copy[at] = word() if r.random() < 0.7 else base[at - 1]
            rows.append((len(rows) * 7 % 1009, " ".join(copy[: len(copy) - r.randint(0, 4)])))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    got = {x.doc_id: x.component_id for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()}
    assert got == {i: find(i) for i in sets}
