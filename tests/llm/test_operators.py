"""Each operator against a brute-force version, on small tables with awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeloom.llm import bpe, common, components, decontaminate, exact_dedup, langid, learning, quality, sharding, simhash, suffix_dedup, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, spans string"
PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "   \t\n ", None),
    (6, f"Before {PHRASE.upper()}, after", "en"),
    (7, "x" * 70_000, "de"),
    (None, "the quick brown fox jumps over the lazy dog again and again", "en"),
    (9, "ñandú 日本語 🙂 ß" * 40, "es"),
    (9, "ñandú 日本語 🙂 ß" * 40, "es"),
    (10, "one", "en"),
    (11, "!!! ... ???", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", None, "clash", "clash", "clash") for i, t, g in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- exact dedup


@pytest.mark.parametrize("least", [1000, 2])
def test_exact_dedup(docs, none, least, monkeypatch):
    monkeypatch.setattr(common, "COMMON_LEAST", least)
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    got = rows(exact_dedup.exact_dedup(docs))
    want = []
    for i, t, _ in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        want.append((i, max(ids), len(groups[t or ""]), i == max(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(got) == Counter(want)
    assert rows(exact_dedup.exact_dedup(none)) == []
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({x[0] for x in want if x[3]})
    again = docs.unionByName(docs).unionByName(docs)
    assert len(rows(exact_dedup.survivors(again))) == len(rows(kept))


def test_cuckoo_index_holds_what_is_live():
    rng = np.random.default_rng(3)
    index, live = exact_dedup.CuckooIndex(buckets=4), {}
    for step in range(20_000):
        key = hashlib.sha256(str(rng.integers(0, 3000)).encode()).digest()
        if key in live and rng.random() < 0.5:
            assert index.remove(key)
            del live[key]
        elif key not in live:
            index.put(key, (step, 1))
            live[key] = (step, 1)
        assert index.get(key) == live.get(key) and len(index) == len(live)
    assert dict(index.items()) == live
    assert index.resizes and not index.remove(b"\0" * 32)


def test_update_index(spark):
    make = lambda xs: spark.createDataFrame(xs, "doc_id long, text string")
    index = exact_dedup.build_index(make([(1, "a"), (2, "b"), (3, "b")]))
    new = exact_dedup.update_index(index, added=make([(9, "a"), (7, "c"), (8, "b")]), removed=make([(0, "b")]))
    assert {(r["keep_id"], r["group_size"]) for r in new.collect()} == {(9, 2), (7, 1), (8, 1)}


def test_small_indexes_give_the_same_entries(monkeypatch):
    rng = np.random.default_rng(8)
    data = sorted((hashlib.sha256(str(rng.integers(0, 500)).encode()).digest(), int(i), 1, int(rng.random() < 0.1)) for i in range(3000))
    data.sort(key=lambda r: (r[0], r[3]))
    want = {}
    for key, keep, size, step in data:
        old = want.pop(key, None)
        if step == 0:
            want[key] = (max(keep, old[0]), size + old[1]) if old else (keep, size)
    monkeypatch.setattr(exact_dedup, "INDEX_ENTRIES", 20)
    columns = [exact_dedup.pa.array(c) for c in zip(*data, strict=True)]
    batch = exact_dedup.pa.record_batch(columns, names=["digest", "keep_id", "group_size", "step"])
    got = [tuple(r.values()) for b in exact_dedup._index(batch.slice(i, 700) for i in range(0, 3000, 700)) for r in b.to_pylist()]
    assert sorted(got) == sorted((k, *v) for k, v in want.items())


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


def test_bpe_agrees_with_tiktoken(docs, none, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = bpe.load_ranks(path)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(ranks, pattern)
    rng = np.random.default_rng(1)
    letters = list("abcthe  \n\t\r.,!'sé ñ日本語🙂\x1c\x85​12٣²%*<|endoftext|>")
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert own.encode(text) == other.encode_ordinary(text)
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs, path, pattern, with_ids=True).collect()}
    assert len(got) == len({i for i, _, _ in ROWS})
    for i, t, _ in ROWS:
        ids = other.encode_ordinary(t or "")
        r = got[i]
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert Counter(bytes(r["content"]) for r in back) == Counter((t or "").encode() for _, t, _ in ROWS)
    assert rows(bpe.encode_digests(none, path, pattern)) == []


# --- sharding


@pytest.mark.parametrize("limit", [10, 300, 1 << 20])
def test_sharding(docs, none, limit):
    got = rows(sharding.assign_shards(docs, limit))
    assert Counter((i, n) for i, _, n, _, _ in got) == Counter((i, len((t or "").encode())) for i, t, _ in ROWS)
    held = Counter()
    for _, shard, n, _, _ in got:
        held[shard] += n
    for _, shard, n, size, oversize in got:
        assert held[shard] == size and oversize == (size > limit)
        assert not oversize or n == size  # only a single text may be over the limit
    bits = {s.partition(".")[0] for s in held}
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    assert rows(sharding.assign_shards(none, limit)) == []


def test_sharding_splits_only_what_is_too_large(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(400)], "doc_id long, text string")
    got = rows(sharding.assign_shards(docs, 5000))
    by = {s: size for _, s, _, size, _ in got}
    assert all(n <= 5000 for n in by.values())
    for shard in by:  # a parent of a leaf was too large
        parent = sum(n for s, n in by.items() if s.startswith(shard[:-1]))
        assert not shard or parent > 5000
    sharding.write_shards(docs, str(tmp_path / "s"), 5000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 400


def test_written_shards_keep_every_row_and_the_limit(spark, tmp_path):
    data = [(1, "a" * 3000), (1, "b" * 3000), (None, "c" * 3000)] + [(7, "same" * 100)] * 55 + [(i, f"{i} " * 50) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(data)], "doc_id long, text string, shard_id string, n int").repartition(5)
    sharding.write_shards(docs, str(tmp_path / "s"), 2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert dict(back.dtypes)["shard_id_"] == "string" and back.columns[:4] == docs.columns
    assert sorted(r["n"] for r in back.collect()) == list(range(len(data)))
    held = Counter()
    for r in back.collect():
        held[r["shard_id_"]] += len(r["text"])
    assert max(held.values()) <= 4000


# --- WARC


def test_warc_round_trip(spark):
    big, odd = "<p>é</p>" * 200, "WARC/1.1\r\n\r\n" * 100
    data = [(1, "http://B.example.com/a", big), (2, "https://www.a.example.com/x?y#z", big), (3, None, None), (4, "http://a.example.com/x?y", odd), (5, "u v\n", odd), (6, "", "short"), (7, "", "short"), (None, "http://c/", big), (8, "x", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string")
    got = rows(warc.capture_histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    want = []
    for i, _, html in data:
        body = (html or "").encode()
        same = [j for j, _, h in data if (h or "") == (html or "") and j is not None]
        first = max(same) if len(body) >= 1000 else i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    assert Counter(got) == Counter(want)
    ordered = warc.capture_histories(pages).select("url_key", "captured_at").collect()
    assert [tuple(r) for r in ordered] == sorted(tuple(r) for r in ordered)
    assert rows(warc.capture_histories(pages.limit(0))) == []


def test_warc_takes_any_id_and_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 5)
    ids = [1 << 62, -(10**12), 10**12, -(1 << 63), (1 << 63) - 1, 0]
    ends = ["", "\r", "\r\n", "\r\n\r", "\r\n\r\n", "\n\r\n\r\n\r\n", "\r\r\n\r\n"]
    data = [(i, f"http://h{k % 3}/{k}", f"{e}page {k}{e}{e}") for k, (i, e) in enumerate((i, e) for i in ids for e in ends)]
    data.append((77, "http://big/", "\r\n\r\nWARC/1.1\r\n" * 200_000))
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    got = rows(warc.capture_histories(pages, str(tmp_path / "w")).select("page_id", "payload_digest", "captured_at"))
    assert Counter(got) == Counter((i, hashlib.sha1(h.encode()).hexdigest(), 946684800 + i % (1 << 32)) for i, _, h in data)
    ordered = [tuple(r) for r in warc.merge_runs(warc.read_runs(spark, str(tmp_path / "w"))).select("url_key", "captured_at").collect()]
    assert ordered == sorted(ordered) and len(ordered) == len(data)


def test_a_damaged_archive_is_refused():
    record = b"WARC/1.1\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [r[3] for r in warc.parse_warc([record[i : i + 1] for i in range(len(record))])] == [b"ab"]
    for broken in (record[:-3], record[4:], record.replace(b"40", b"39"), record.replace(b"40", b"4000")):
        with pytest.raises(ValueError, match="record"):
            list(warc.parse_warc([broken]))


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 9, rng.integers(0, 12)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://user@WWW.Example.com:80/A?B#c") == "com,example)/a?b"
    assert warc.url_key("http://example.com") == "com,example)/"


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_contamination(texts, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item) if item is not None else "null")
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= names
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 10])
def test_contamination(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "blocks_of", lambda b, w, f=decontaminate.blocks_of: f(b, w, block))
    monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", 3)
    items = [(7, PHRASE), (2, "one"), (3, None), (4, ""), (12, "fox jumps"), (None, "lazy dog"), (7, PHRASE), (10, PHRASE + " more")]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words int")
    got = rows(decontaminate.contamination(docs, benchmark))
    want = brute_contamination([t for _, t, _ in ROWS], items)
    assert Counter(r[1:] for r in got) == Counter(want)
    assert rows(decontaminate.contamination(none, benchmark)) == []
    assert not any(r[-1] for r in rows(decontaminate.contamination(docs, benchmark.limit(0))))
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert not any(r[-1] for r in rows(decontaminate.contamination(clean, benchmark)))
    before, after = Counter(t for _, t, _ in ROWS), Counter(r["text"] for r in clean.collect())
    assert after[None] == before[None] and after["x" * 70_000] == 1
    if block == 10:  # in passes or at once, the same is cut
        monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", 1000)
        assert Counter(rows(decontaminate.decontaminated(docs, benchmark))) == Counter(rows(clean))


def test_search_on_random_texts():
    rng = np.random.default_rng(5)
    for _ in range(40):
        say = lambda n: " ".join(rng.choice(list("abcdef"), n))
        items = [(i, say(rng.integers(0, 9))) for i in range(6)]
        texts = [say(rng.integers(0, 60)) for _ in range(5)]
        block = decontaminate.make_block([(str(i), t) for i, t in items], 4)
        got = [(n, sum(b - a for a, b in s), len(x)) for n, s, x in decontaminate.search(block, texts)]
        assert got == [w[:3] for w in brute_contamination(texts, items, 4)]


# --- suffix structures


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = suffixes.FmIndex(text, 7)
    for size in (1, 2, 3, 5):
        patterns = np.unique(rng.integers(1, 6, (60, size)), axis=0)
        low, high = index.find(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_run_length_index():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = "".join(rng.choice(list("ab"), 60))
        strings = [(base[i : i + rng.integers(1, 40)] + rng.choice(["", "c", "ab"])).encode() for i in rng.integers(0, 20, rng.integers(1, 12))]
        length = int(rng.choice([1, 3, 8, 15]))
        index = suffixes.RunLengthIndex(strings)
        got = {(k, i) for which, place, longest in index.statistics(np.arange(len(strings))) for k, i, n in zip(which.tolist(), place.tolist(), longest.tolist(), strict=True) if n >= length}
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        assert got == {(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1}


# --- repeated passages


def brute_passages(texts, length, words, short):
    """Stretches and bytes that repeated passages cover."""
    found = []
    for t in texts:
        d = (t or "").encode()
        begins = [m.start() for m in re.finditer(rb"[^ \t\n\v\f\r]+", d)]
        reach = [min(length, max(short, begins[k + words - 1] + 1 - p)) if k + words <= len(begins) else length for k, p in enumerate(begins)]
        found.append([(p, d[p : p + n]) for p, n in zip(begins, reach, strict=True) if p + n <= len(d)])
    seen = Counter(x for f in found for _, x in f)
    out = []
    for t, f in zip(texts, found, strict=True):
        gone = [0] * (len((t or "").encode()) + 1)
        for p, x in f:
            if seen[x] > 1:
                gone[p : p + len(x)] = [1] * len(x)
        runs = [sum(k) for v, k in groupby(gone) if v]
        out.append((len(runs), sum(runs)))
    return out


def brute_repeats(texts, length, words, short):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, passages in zip(data, brute_passages(texts, length, words, short), strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for k, _ in groupby(gone) if k), hashlib.sha256(kept).hexdigest(), *passages))
    return out


@pytest.mark.parametrize(("length", "words", "short", "hot", "large"), [(400, 51, 272, 2000, 200_000), (300, 20, 120, 2000, 200_000), (300, 20, 120, 2, 5), (40, 6, 24, 2000, 200_000), (40, 6, 24, 1, 1), (30, 3, 9, 0, 200_000), (30, 4, 30, 2000, 200_000)])
def test_remove_repeats(spark, none, length, words, short, hot, large, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_OWNER", hot)
    monkeypatch.setattr(suffix_dedup, "LARGE_OWNER", large)
    monkeypatch.setattr(suffix_dedup, "LARGE_SHARE", 64 if large > 1000 else 1)
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 2000)
    rng = np.random.default_rng(length + hot + words)
    say = lambda n: "".join(rng.choice(list("abcdé   \n"), n))
    passage, brief = say(length + 40), say(max(short + 6, length * 3 // 4))
    texts = [say(rng.integers(0, 900)) for _ in range(25)]
    texts += [say(30) + passage + say(200) for _ in range(12)] + [say(length * 3) + "x" * (3 * length)] + ["ab " * length, "ab " * (length + 9), None, "", passage[: length - 1]]
    texts += [say(rng.integers(0, 60)) + sep + brief + say(rng.integers(0, 60)) for sep in ("", " ", "q", " ", "\n")] + [brief, passage, "c" + passage]
    texts += [texts[3], texts[3], texts[30][:50] + "#" + texts[30][50:]]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = rows(suffix_dedup.remove_repeats(docs, length, words, short, with_kept=False))
    assert Counter(r[1:] for r in got) == Counter(brute_repeats(texts, length, words, short))
    assert rows(suffix_dedup.remove_repeats(none, length)) == []


def test_a_passage_behind_many_prefixes(spark):
    """One owner with thousands of contexts has its windows counted, and no index holds them all."""
    rng = np.random.default_rng(11)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(80))
    texts = [f"{i * 7919 % 10_007} {i} {passage}" for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(suffix_dedup.remove_repeats(docs, with_kept=False))
    assert Counter(r[1:] for r in got) == Counter(brute_repeats(texts, 400, 51, 272))
    assert all(r[2] >= len(passage) and r[5] == 1 for r in got)


# --- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, distance):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for f, i in zip(fps, ids, strict=True):
        least[find(f)].append(i)
    return [min((i for i in least[find(f)] if i is not None), default=None) for f in fps]


@pytest.mark.parametrize("least", [1000, 2])
def test_simhash(docs, none, least, monkeypatch):
    monkeypatch.setattr(common, "COMMON_LEAST", least)
    got = Counter(rows(simhash.near_duplicates(docs)))
    fps = [brute_fingerprint(t) for _, t, _ in ROWS]
    roots = brute_components(fps, [i for i, _, _ in ROWS], 4)
    assert got == Counter((i, f"{f:016x}", c) for (i, _, _), f, c in zip(ROWS, fps, roots, strict=True))
    assert rows(simhash.near_duplicates(none)) == []
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect() if r["doc_id"] != 9) == sorted({c for c in roots if c not in (None, 9)})


@pytest.mark.parametrize("block", [20_000, 7])
@pytest.mark.parametrize("partitions", [2, 3, 4, 6])
def test_links_connect_all_within_distance(spark, block, partitions):
    rng = np.random.default_rng(partitions)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = set(rng.integers(-(1 << 62), 1 << 62, 60).tolist())
    for c in centres.tolist():
        for _ in range(40):
            flip = 0
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                flip |= 1 << b
            fps.add(int(np.uint64(c ^ flip & (1 << 64) - 1 if flip < 1 << 63 else (c ^ flip) & (1 << 64) - 1).astype(np.int64)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.link(frame, 4, partitions, block)).collect()}
    wide = [f & (1 << 64) - 1 for f in fps]
    want = brute_components(wide, fps, 4)
    assert [found.get(f, f) for f in fps] == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = dict(rows(components.components(edges)))
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_allocation_covers_the_distance():
    histograms = [np.ones(256, np.int64), np.eye(1, 256, dtype=np.int64)[0] * 500, np.ones(256, np.int64)]
    costs = [np.cumsum(simhash.pairs_by_distance(h))[:5] for h in histograms]
    thresholds = simhash.allocate(costs, 4)
    assert sum(t + 1 for t in thresholds) == 5 and thresholds[1] == -1
    pairs = simhash.pairs_by_distance(np.array([2, 1, 0, 3]))
    assert pairs.round().tolist() == [14, 10, 12]


def test_partitions_follow_the_number_of_fingerprints():
    """Fewer and wider partitions the more there are, by the estimate for evenly spread bits."""

    def cheapest(total):
        def cost(n):
            widths = [64 // n + (i < 64 % n) for i in range(n)]
            parts = [[np.full(1 << len(p), total / (1 << len(p))) for p in simhash.pieces_of(list(range(w)))] for w in widths]
            costs = [simhash.costs_of(p, w, total, 4) for p, w in zip(parts, widths, strict=True)]
            return sum(c[t] for c, t in zip(costs, simhash.allocate(costs, 4), strict=True) if t >= 0)

        return min(simhash.PARTITIONS, key=cost)

    assert [cheapest(n) for n in (10**5, 10**9, 10**11)] == [4, 3, 2]


def test_blocks_count_members_and_probes():
    blocks = simhash.blocks_of(np.array([5, 4]), np.array([30, 25]), simhash.masks(4, 1), 20)
    assert blocks[np.array([5, 4, 7, 0, 6, 9])].tolist() == [3, 3, 2, 2, 2, 1]


# --- learned operators


def test_language_identification(spark, docs, none):
    rng = np.random.default_rng(0)
    syllables = {"aa": ["ka", "mo", "ri"], "bb": ["sch", "ung", "der"], "cc": ["eau", "que", "ont"]}
    data = [(i, " ".join("".join(rng.choice(syllables[g], 3)) for _ in range(30)), g) for i in range(300) for g in [list(syllables)[i % 3]]]
    data += [(1000, None, "aa"), (1001, "123 !", "bb"), (1002, "", None), (1003, data[0][1], None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(frame).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    held = [(i, g) for i, _, g in data[:300] if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([got[i]["lang_pred"] == g for i, g in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert rows(langid.identify(none)) == []
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_codewords_are_apart():
    for n in (1, 2, 3, 5, 9, 20):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code.tolist()}) == n


def test_toxicity(spark, none):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "ou", "st"], rng.integers(1, 4)))
    data, labels = [], []
    for i in range(500):
        text = [word() for _ in range(rng.integers(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(text) // 15)):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["wretch", "vermin", "dimwit"])))
        data.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    data += [(900, None), (901, ""), (902, data[0][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (900, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, known).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert got[901]["score"] == got[900]["score"] and got[901]["predicted"] == 0
    assert got[902]["score"] == got[0]["score"]
    assert rows(toxicity.classify(none, known)) == []
    assert {r["score"] for r in toxicity.classify(docs, known.limit(0)).collect()} == {0.0}


def test_quality(spark, docs, none):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "ou", "st"], rng.integers(1, 4)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(w + "%%%" for w in good[i].split()) for i in range(20)] + ["spam spam spam " * 60 for _ in range(15)] + [" ".join(w.upper() + "!!" for w in good[i].split()) for i in range(10)]
    frame = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(frame).collect()}
    want = {i: i < len(good) for i in got}
    assert np.mean([got[i] == want[i] for i in got]) > 0.97
    kept = quality.accepted(frame)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    assert len(rows(quality.classify(docs))) == len(ROWS)
    assert rows(quality.classify(none)) == [] and rows(quality.accepted(none)) == []


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.array([np.where(rng.random(4000) < a, y, ~y) for a in right]).T.astype(int)
    counts = Counter("".join(map(str, v)) for v in votes.tolist())
    model = quality.fit_labels(sorted(counts.items()))
    assert np.abs(model.accuracy - right).max() < 0.05 and abs(model.prior - 0.7) < 0.05


def brute_em(patterns, rounds):
    """Expectation maximisation text by text and labeller by labeller, as the definitions say it."""
    texts = [[int(c) for c in p] for p, n in patterns for _ in range(n)]
    width = len(texts[0])
    good = [min(0.98, max(1e-6, 0.1 ** t.count(0))) for t in texts]
    for _ in range(rounds):
        prior = min(0.99, max(0.01, sum(good) / len(texts)))
        given = []
        for j in range(width):
            votes = sum(t[j] != 2 for t in texts)
            rows = []
            for y in (0, 1):
                held = [0.1 + quality.BELIEF_SHARE * votes * (prior if y else 1 - prior) * (quality.BELIEF if v == y else 1 - quality.BELIEF) for v in (0, 1)]
                for t, g in zip(texts, good, strict=True):
                    if t[j] != 2:
                        held[t[j]] += g if y else 1 - g
                rows.append([h / sum(held) for h in held])
            given.append(rows)
        good = []
        for t in texts:
            odds = np.log(prior / (1 - prior)) + sum(np.log(given[j][1][v] / given[j][0][v]) for j, v in enumerate(t) if v != 2)
            good.append(1 / (1 + np.exp(-min(30, max(-30, odds)))))
    return prior, dict(zip(("".join(map(str, t)) for t in texts), good, strict=True))


def test_label_model_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(5):
        patterns = sorted(Counter("".join(rng.choice(list("0112"), 4)) for _ in range(60)).items())
        prior, good = brute_em(patterns, 30)
        model = quality.fit_labels(patterns, 30)
        assert model.prior == pytest.approx(prior)
        for p, _ in patterns:
            assert quality.posterior(model, [int(c) for c in p]) == pytest.approx(good[p], abs=1e-9)


def test_quality_scores_against_brute_force(spark, docs):
    """Every row's score is that of the linear model on the hashed grams and measures of its whole text."""
    model, weights = quality.fit(docs)
    got = Counter((r["doc_id"], round(r["score"], 6), round(r["posterior"], 6)) for r in quality.score(docs, model, weights).collect())
    want = Counter()
    for i, t, _ in ROWS:
        m = quality.measures(t or "")
        z = float(np.dot(quality.features(t or "", m), weights[:-1]) + weights[-1])
        want[i, round(1 / (1 + float(np.exp(-z))), 6), round(quality.posterior(model, quality.votes(m)), 6)] += 1
    assert got == want


def test_decoding_against_brute_force():
    """A language's score follows from its weighted losses, bit by bit; the best is the least loss, ties go to the first."""
    rng = np.random.default_rng(9)
    for n in (2, 3, 6):
        code = langid.codewords(n)
        trust = rng.random(code.shape) + 0.01
        trust /= trust.sum(axis=1, keepdims=True)
        model = langid.LanguageModel([f"l{i}" for i in range(n)], code, trust, rng.normal(size=(8, code.shape[1])))
        x = rng.normal(size=(20, 7))
        p = langid.decode(model, x)
        for row, got in zip(x, p, strict=True):
            losses = []
            for c in range(n):
                loss = 0.0
                for b in range(code.shape[1]):
                    f = sum(row[k] * model.weights[k, b] for k in range(7)) + model.weights[7, b]
                    loss += trust[c, b] * np.log(1 + np.exp(-float(code[c, b]) * max(-8.0, min(8.0, f))))
                losses.append(loss)
            want = np.exp(-4 * (np.array(losses) - min(losses)))
            assert np.allclose(got, want / want.sum(), atol=1e-6) and got.argmax() == int(np.argmin(losses))


def test_toxicity_scores_against_brute_force(spark):
    """A score follows from the bytes that either dictionary's compressor needs for each window, without memory of others."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "ou"], rng.integers(1, 4)))
    sample = [(" ".join([word() for _ in range(40)] + ["vermin", "dimwit"] * (i % 3 == 0)), str(int(i % 3 == 0))) for i in range(90)]
    model = toxicity.train(sample)
    texts = [sample[0][0], sample[1][0], "", None, "Vermin " * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    for i, text in enumerate(texts):
        saved = []
        for w in (text or "").lower().split():
            data = f" {w} ".encode() + toxicity.PRIMER
            one, other = (len(toxicity._compressor(d).compress(data)) for d in (model.ordinary, model.toxic))
            saved.append(min(toxicity.MOST, max(toxicity.LEAST, one - other)))
        n, odds = len(saved), sum(model.odds[s - toxicity.LEAST] for s in saved)
        over = [sum(s >= t for s in saved) for t in toxicity.STEPS]
        x = [np.sign(odds) * np.log1p(abs(odds)), odds / np.sqrt(n + 1), odds / (n + 1), *(np.log1p(c) for c in over), *(np.sqrt(c / (n + 1)) for c in over), np.log1p(n)]
        z = sum(((a - m) / s) * w for a, m, s, w in zip(x, model.mean, model.spread, model.weights[:-1], strict=True)) + model.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "t" * 100) for i in range(2000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    assert 150 < len(learning.labelled_sample(docs, labels, 100)) < 260
    assert len(learning.labelled_sample(docs, labels, 100, sample_bytes=5000)) <= 50
    near = spark.createDataFrame([(i, "t" * 300) for i in range(500)], "doc_id long, text string")
    got = learning.labelled_sample(near, near.selectExpr("doc_id", "'x' as label"), 400, sample_bytes=5000)
    assert len(got) == 16  # 300 bytes are below a sixteenth of 5000, and 16 of them fit
    several = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string")
    known = labels.filter("doc_id < 40")
    one = sorted(learning.labelled_sample(several, known, 400))
    assert len(one) == 40 == len({t for t, _ in one}) and one == sorted(learning.labelled_sample(several.repartition(7), known, 400))
    assert learning.labelled_sample(docs, labels.limit(0)) == []


# --- pipeline


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(pipeline.STAGES) == 5
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < 4:
            assert out.columns == base.columns
        out.write.parquet(str(tmp_path / f"s{i}"))
        at = spark.read.parquet(str(tmp_path / f"s{i}"))
    assert at.count() <= len(ROWS)
    assert sorted(r["decoded_sha256"] for r in pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["decoded_sha256"] for r in at.collect())


def brute_cut(text, items):
    """``text`` without hit words and what stands between them, until no window is left."""
    while True:
        found = [m.span() for m in WORD.finditer(text.translate({i: i + 32 for i in range(65, 91)}))]
        said = [text[a:b].lower() for a, b in found]
        hit = set()
        for item in items:
            w = words(item)
            for j in range(len(w) - 9):
                hit |= {i + k for i in range(len(said) - 9) if said[i : i + 10] == w[j : j + 10] for k in range(10)}
        if not hit:
            return text
        for i in sorted(hit, reverse=True):
            text = text[: found[i][0]] + text[found[i + 1][0] if i + 1 in hit else found[i][1] :]


def test_pipeline_against_brute_force(spark, tmp_path, vocabulary):
    import tiktoken

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)
    say = lambda n: " ".join("".join(rng.choice(["the", "an", "er", "in", "ou", "st"], rng.integers(1, 4))) for _ in range(n))
    texts = [say(60) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7], say(20) + " " + PHRASE.upper() + ", " + say(20), PHRASE + " " + say(30), "%%% &&& " * 40, "spam spam " * 60, None, ""]
    long = say(900)
    texts += [long, long[:-3], long + " x", say(30) + " " + " ".join(PHRASE.split()[:9]) + " " + say(30)]
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    keep = {r["doc_id"] for r in quality.classify(at).collect() if r["keep"]}  # the scorer has a test of its own
    assert 50 < len(keep) < len(texts)
    latest = {}
    for i, t in enumerate(texts):
        if i in keep:
            latest[t or ""] = i
    left = sorted(latest.values())
    fps = [brute_fingerprint(texts[i]) for i in left]
    left = sorted(set(brute_components(fps, left, 4)))
    other = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=bpe.load_ranks(vocabulary[0]), special_tokens={})
    want = {}
    for i in left:
        text = brute_cut(texts[i] or "", [PHRASE])
        want[i] = (other.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
