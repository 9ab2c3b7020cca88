"""Each corpus operator against a plain version, on texts with every odd case: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import bpe, components, decontam, quality_model, quality_rules, simhash, substring, suffix_dedup, token_counts, toxicity, warc
from tickloom.llm.anchors import runs
from tickloom.llm.arrays import joined
from tickloom.llm.gray_index import GrayIndex, gray_rank
from tickloom.llm.queries import tokenizer_path
from tickloom.llm.suffix_array import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, key int, block int, bucket int, row int, node int, ws int, code int, rest int, decision int, found int, held_out int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = sentence(rng, 300), sentence(rng, 60)
    near = base.split(" ")
    near[7], near[150] = "changed", "too"
    out = [
        base, base, " ".join(near), None, "", "   \n\t ", "one", "two words", "UPPER case words\u0085 and \x1c marks",
        passage, sentence(rng, 40) + " " + passage + " " + sentence(rng, 30), sentence(rng, 20) + "\n" + passage, passage * 2, "a " * 4000,
        "x" * 30_000, sentence(rng, 3000), base.upper(), "line\nline\n\nline\nother line", "é" * 200, "<|endoftext|> mixed <|startoftext|> it's 123 don't!!",
        "日本語 テキスト ΑΣ ΑΣΑ", "ab" * 150, passage.replace(" ", "\n"),
    ]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, *[0] * 12) for i, t in texts.items()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_are_the_librarys(docs, nothing, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=100))
    for i, text in texts.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 100)
    assert token_counts.token_counts(nothing, tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_long_texts_are_cut_where_it_is_safe():
    text = " ".join(sentence(random.Random(1), 30) for _ in range(5))
    parts = list(token_counts.pieces(text, 50))
    assert "".join(parts) == text and len(parts) > 5 and all(p[0] == " " for p in parts[1:])


def test_token_counts_of_pieces_and_small_batches(texts, monkeypatch):
    from tokenizers import Tokenizer

    for name, value in (("PIECE_CHARS", 50), ("BATCH_BYTES", 20), ("MEMO_BYTES", 2000)):
        monkeypatch.setattr(token_counts, name, value)
    path = tokenizer_path("byte_bpe_50k.json")
    t, lengths = Tokenizer.from_file(path), token_counts.Lengths(path)
    some = [x or "" for x in texts.values()]
    for k in (3, len(some)):
        assert [n for i in range(0, len(some), k) for n in lengths.counts(some[i : i + k])] == [len(t.encode(x, add_special_tokens=False).ids) for x in some]


def test_bpe_gives_the_librarys_ids_and_texts(docs, nothing, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got, encoded = by_id(bpe.digests(docs, path)), bpe.encode(docs, path)
    ids, back = by_id(encoded), by_id(bpe.decode(encoded, path))
    for i, text in texts.items():
        want = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(want, skip_special_tokens=False)
        assert ids[i]["ids"] == want and back[i]["text"] == decoded and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digests(nothing, path).collect() == [] and bpe.encode_decode(nothing, path).collect() == []


def test_bpe_of_hard_words():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(2)
    c, t = bpe.codec(path), Tokenizer.from_file(path)
    for _ in range(1500):
        word = "".join(rng.choice(rng.choice(["ab", "thenio", "aeé-!", "hs'"])) for _ in range(rng.randint(1, 40)))
        assert c.encode(word) == t.encode(word, add_special_tokens=False).ids


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_ledger(docs, nothing, texts):
    got = by_id(quality_rules.ledger(docs))
    for i, text in texts.items():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measured(text)
        assert bool(r["failed"] & quality_rules.mask("base")) == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    table = {r["rule"]: r for r in quality_rules.ablation(quality_rules.ledger(docs), "v1").collect()}
    m = quality_rules.mask("v1")
    for rule, r in table.items():
        bit = 1 << quality_rules.BIT[rule]
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in got.values())
        assert r["n_failed_alone"] == sum(x["failed"] & m == bit for x in got.values())
        assert r["n_kept_without"] == sum(x["failed"] & m & ~bit == 0 for x in got.values())
    assert quality_rules.ledger(nothing).collect() == []


def test_substring_windows(docs, nothing, texts):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = by_id(substring.remove_repeats(docs, block_bytes=500, bucket_bytes=500))
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        assert got[i]["n_words"] == len(w) and got[i]["text"] == " ".join(x for p, x in enumerate(w) if p not in gone)
        assert {p for s in got[i]["intervals"] for p in range(s["first"], s["last"] + 1)} == gone
        assert all(a["last"] + 1 < b["first"] for a, b in zip(got[i]["intervals"], got[i]["intervals"][1:], strict=False))
    assert substring.remove_repeats(nothing).collect() == []


def test_substring_repeated_rows_and_null_ids(spark):
    text = sentence(random.Random(9), 30)
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"]) > 0) for r in substring.remove_repeats(rows).collect())
    assert left == [(False, 1, False), (False, 1, False), (False, 2, False), (True, 0, True)]


def test_substring_rows_of_one_id_in_many_blocks(spark):
    """Rows with equal ids, or without one, are dealt apart by their texts; still they do not remove each other's windows."""
    rng = random.Random(10)
    shared = sentence(rng, 20)
    for own in (None, 7):
        rows = spark.createDataFrame([(own, f"{sentence(rng, 3)} {shared}") for _ in range(40)] + [(9, shared)], "doc_id long, text string")
        got = substring.remove_repeats(rows, block_bytes=20, bucket_bytes=20).collect()
        assert sorted(len(r["text"].split()) for r in got) == [0] + [23] * 40


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 60))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert len(suffix_array(np.array([], dtype=int))) == 0


def test_anchors_depend_on_the_window_alone():
    import pyarrow as pa

    text = sentence(random.Random(4), 200).encode()
    place = {}
    for shift in (0, 17):
        buf, starts, ends = joined(pa.array([(b"z" * shift + text).decode()]))
        for _, first, last, anchor, key, _ in zip(*runs(buf, starts, ends, 100, 32), strict=True):
            for p in range(first, last + 1):
                if p >= shift:
                    place.setdefault(p - shift, set()).add((anchor - p, key))
    assert len(place) == len(text) - 99 and all(len(x) == 1 for x in place.values())


def plain_suffix(texts, length):
    raw, first = {i: (t or "").encode() for i, t in texts.items()}, {}
    out = {}
    for i in sorted(raw):
        gone = bytearray(len(raw[i]))
        for p in range(len(raw[i]) - length + 1):
            if first.setdefault(raw[i][p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        out[i] = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g), sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1])), sum(gone)
    return out


def test_suffix_dedup(docs, nothing, texts):
    want = plain_suffix(texts, 100)
    got = by_id(suffix_dedup.remove_repeats(docs, block_bytes=5000, bucket_bytes=4000, carry=("lang", "n_chars")))
    for i in texts:
        kept, spans, gone = want[i]
        assert (bytes(got[i]["kept"]), len(got[i]["spans"]), got[i]["n_bytes"]) == (kept, spans, len(kept) + gone)
        assert got[i]["rest"]["lang"] == "en"
    assert suffix_dedup.remove_repeats(nothing).collect() == []


def test_suffix_dedup_of_periods_and_overlaps(spark):
    rng = random.Random(11)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 140))) for _ in range(6)]
    texts = {i: "".join(rng.choice([*parts, "ab" * 70, "é" * 60]) for _ in range(rng.randint(1, 6))) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(suffix_dedup.remove_repeats(rows, block_bytes=1500, bucket_bytes=1500))
    for i, (kept, spans, _) in plain_suffix(texts, 100).items():
        assert (bytes(got[i]["kept"]), len(got[i]["spans"])) == (kept, spans)
    for r in suffix_dedup.remove_repeats(rows, whole=True).collect():
        bytes(r["kept"]).decode()


@pytest.mark.parametrize("hot", [0, 3, suffix_dedup.HOT])
def test_suffix_dedup_of_a_passage_with_other_surroundings_everywhere(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_RUNS", 7)
    rng = random.Random(12)
    passage = sentence(rng, 40)
    texts = {i: sentence(rng, rng.randint(0, 9)) + rng.choice(["", " ", "a"]) + passage + rng.choice(["", "b", "bé "]) + sentence(rng, rng.randint(0, 9)) for i in range(150)}
    texts |= {200: texts[3], 201: texts[3][20:] + "x"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = by_id(suffix_dedup.remove_repeats(rows, block_bytes=2000, bucket_bytes=2000))
    for i, (kept, spans, gone) in plain_suffix(texts, 100).items():
        assert (bytes(got[i]["kept"]), len(got[i]["spans"]), got[i]["n_bytes"]) == (kept, spans, len(kept) + gone)


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(13)
    text, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(5, text), (5, text), (5, text + other), (None, text), (None, text), (None, "q" + other), (9, other), (9, None), (None, None), (None, "")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=100, bucket_bytes=100).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_bytes"]), []).append(bytes(r["kept"]))
    n, m = len(text.encode()), len(other.encode())
    # Null ids come first, and equal rows count as one document.
    assert by[None, n] == [text.encode()] * 2 and by[None, m + 1] == [b"q" + other.encode()]
    assert by[5, n] == [b""] * 2 and by[9, m] == [b""] and by[9, 0] == [b""] and by[None, 0] == [b""] * 2
    assert by[5, n + m][0] == plain_suffix({0: text, 1: "q" + other, 2: text + other}, 100)[2][0]


def test_gray_index():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 4)).astype(np.uint64)) for _ in range(600)], np.uint64)
    codes = np.unique(centre[rng.integers(0, 30, 600)] ^ flips)
    got = {(int(a), int(b)) for q, c in GrayIndex(codes).within(codes, 2, chunk=64) for a, b in zip(q, c, strict=True)}
    d = np.bitwise_count(codes[:, None] ^ codes)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 2), strict=True)}
    assert sorted(gray_rank(np.arange(256, dtype=np.uint64) ^ (np.arange(256, dtype=np.uint64) >> np.uint64(1))).tolist()) == list(range(256))


@pytest.mark.parametrize(("chunk", "most"), [(2048, 1 << 20), (7, 50), (64, 300)])
def test_gray_index_links_what_all_pairs_link(chunk, most):
    rng = np.random.default_rng(2)
    for radius in (0, 2, 7):
        centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        flips = [np.where(rng.random(500) < 0.5, np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64), np.uint64(0)) for _ in range(8)]
        codes = rng.permutation(np.unique(centre[rng.integers(0, 20, 500)] ^ np.bitwise_xor.reduce(flips)))
        group = rng.integers(0, 3, len(codes))
        label = GrayIndex(codes, group).linked(radius, chunk, most)
        want = reach(len(codes), lambda a, b: group[a] == group[b] and (codes[a] ^ codes[b]).bit_count() <= radius)  # noqa: B023
        assert len(set(label.tolist())) == len(set(want)) == len(set(zip(label.tolist(), want, strict=True)))


def test_gray_index_does_not_meet_all_pairs_of_a_cluster(monkeypatch):
    rng, met, search = np.random.default_rng(3), [], GrayIndex.unlike
    flips = [np.where(rng.random(20_000) < 0.5, np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64), np.uint64(0)) for _ in range(8)]
    codes = np.unique(np.bitwise_xor.reduce(flips))

    def counted(self, queries, *rest):
        found = search(self, queries, *rest)
        met.append(0 if found is None else len(found[0]))
        return found

    monkeypatch.setattr(GrayIndex, "unlike", counted)
    assert len(np.unique(GrayIndex(codes).linked(7))) == 1 and sum(met) < 10 * len(codes)


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_simhash_groups(docs, nothing, texts, monkeypatch):
    codes = [fingerprint(texts[i]) for i in sorted(texts)]
    want = reach(len(codes), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 2)
    for hot in (simhash.HOT, 0):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = by_id(simhash.groups(docs))
        for i in texts:
            assert (got[i]["code"] & (1 << 64) - 1, got[i]["component_id"]) == (codes[i], want[i])
    assert simhash.groups(nothing).collect() == []


@pytest.mark.parametrize("hot", [0, 300, simhash.HOT])
def test_simhash_links_at_larger_radii(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(16)
    codes = [rng.getrandbits(64) for _ in range(40)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for c in rng.choices(codes, k=260)]
    codes = sorted(c - (c >> 63 << 64) for c in set(codes))
    table = spark.createDataFrame([(c,) for c in codes], "code long")
    for radius in (3, 7):
        got = {r["node"]: r["root"] for r in components.components(simhash.links(table, len(codes), radius)).collect()}
        want = reach(len(codes), lambda a, b: ((codes[a] ^ codes[b]) & (1 << 64) - 1).bit_count() <= radius)  # noqa: B023
        assert [got.get(c, c) for c in codes] == [codes[i] for i in want]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    want = reach(400, lambda a, b: (a, b) in edges or (b, a) in edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    table = spark.createDataFrame(edges + edges[:9] + [(None, 3), (500, None), (7, 7)], "a long, b long").repartition(3)
    for most in (1, 10, 1 << 19):  # by steps over the whole table alone, by both kinds, by one step
        got = components.components(table, most).collect()
        assert len(got) == len(touched)
        assert {r["node"]: r["root"] for r in got} == {x: want[x] for x in touched}
    assert components.components(table.limit(0)).collect() == []


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for g in range(12):
        words = sentence(rng, 200).split(" ")
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(200)] = f"edit{g}{c}{rng.random()}"
            truth[len(rows)] = {" ".join(w[k : k + 5]) for k in range(196)}
            rows.append((len(rows), " ".join(w)))
    got = {r["node"]: r["root"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = lambda a, b: len(truth[a] & truth[b]) >= 0.8 * len(truth[a] | truth[b])
    want = reach(len(rows), similar)
    assert [got.get(i, i) for i in range(len(rows))] == want


def test_sketches_never_rule_out_similar_sets(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):
        words = sentence(rng, rng.choice([5, 40, 300, 900])).split(" ")
        rows.append((2 * i, " ".join(words)))
        for _ in range(rng.randint(0, len(words) // 20)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((2 * i + 1, " ".join(words * rng.choice([1, 1, 3]))))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.translate(LOWER).split(" ")) for i, t in rows)}
    got = {r["node"]: r for r in simhash.sketches(spark.createDataFrame(rows, "node long, text string"), 5).collect()}
    for i in sets:
        assert got[i]["size"] == len(sets[i])
        for j in range(i % 7, len(sets), 7):
            assert simhash.bins_apart(bytes(got[i]["sketch"]), bytes(got[j]["sketch"])) <= len(sets[i] ^ sets[j])


def joined_as(texts, spark):
    """(roots found, roots by comparing all pairs of texts of five words or more)."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.translate(LOWER).split(" ") for t in texts)]
    got = {r["node"]: r["root"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got.get(i, i) for i in range(len(texts))], reach(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_near_duplicates_in_a_family_of_a_template(spark):
    # Any two texts are at 0.78 by their template; one in five has a true copy among them.
    rng = random.Random(9)
    template, texts = sentence(rng, 171).split(" "), []
    for i in range(900):
        own = sentence(rng, 19).split(" ")
        texts.append(" ".join(template[:86] + own + template[86:]))
        if i % 5 == 0:
            own[rng.randrange(19)] = "edit"
            texts.append(" ".join(template[:86] + own + template[86:]))
    got, want = joined_as(rng.sample(texts, len(texts)), spark)
    assert got == want and len(set(want)) == 900


def test_near_duplicates_of_few_words(spark):
    # 8 and 9 words: 4 of 5 shingles in common, exactly 0.8.
    rng, texts = random.Random(10), []
    for _ in range(60):
        short = sentence(rng, 8)
        texts += [short, short + " more"]
    got, want = joined_as(rng.sample(texts, len(texts)), spark)
    assert got == want and len(set(want)) == 60


def test_decontamination(spark, docs, nothing, texts):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall((t or "").translate(LOWER))
    first = words(texts[0])
    bench = [(0, " ".join(first[20:45]).upper()), (1, " ".join(first[40:52])), (2, "two words"), (3, None), (4, "..."), (5, "one"), (6, " ".join(["a"] * 12)), (7, "never there at all"), (8, " ".join(first[20:45]))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = by_id(decontam.decontaminate(docs, table))
    for i, text in texts.items():
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            size = min(len(b), 10)
            grams = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for k in range(len(w) - size + 1) if b else ():
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    items.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(items))
    assert decontam.decontaminate(nothing, table).collect() == []
    assert all(r["n_hit"] == 0 for r in decontam.decontaminate(docs, table.where("false")).collect())


def test_decontamination_runs_no_python(docs, spark):
    plan = decontam.decontaminate(docs, spark.createDataFrame([(1, "some words here")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_warc(spark, nothing):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 300_000, "<p>a</p>\r\n\r\nrest", ""]
    pages = spark.createDataFrame([(i + 5, f"http://x/{i}\nz", h, 1) for i, h in enumerate(html)] + [(None, None, "<p>a</p>", 1), (5, "again", "<p>a</p>", 2)], "page_id long, url string, html string, sha int")
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r["page_id"] is None, r["page_id"], r["url"]))
    import base64

    assert len(got) == 9
    for r in got:
        text = "<p>a</p>" if r["page_id"] is None else html[r["page_id"] - 5] or ""
        same = min([i + 5 for i, h in enumerate(html) if (h or "") == text])
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == same else ("revisit", same))
        assert r["payload"] is None if r["refers_to"] else bytes(r["payload"]) == text.encode()
    small = warc.round_trip(pages, least_bytes=100).where("page_id IS NOT NULL")
    assert {r["record_type"] for r in small.collect()} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).collect() == []


def test_warc_bundle_is_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    pages = spark.createDataFrame([(i, "u", "x" * 200_000 + str(i)) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    index = warc.write(pages, str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert index.select("frame").distinct().count() > 2 and len(files) == index.select("bundle").distinct().count()
    data = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True).read() for f in files)
    assert data.count(b"WARC/1.1\r\n") == 9


def test_warc_bundles_are_read_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 2)
    pages = spark.createDataFrame([(i, "u", str(i) * 300_000) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    index = warc.write(pages, str(tmp_path / "w"))
    assert index.selectExpr("bundle", "frame div 2").distinct().count() > index.select("bundle").distinct().count()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(index).collect()} == {i: str(i) * 300_000 for i in range(9)}


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of two kinds of junk and insults, with labels."""
    rng = random.Random(12)
    stems = ["grumblo", "snarkel", "idiot"]
    rows, labels = [], []
    for i in range(1500):
        words = sentence(rng, rng.randint(60, 120)).split(" ")
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["", "a", "en", "ix"])
        if not good:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, held_out int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(scores, labels, target):
    both = scores.join(labels, "doc_id").where("held_out").select("predicted", target).collect()
    assert len(both) > 200
    return sum(r[0] == r[1] for r in both) / len(both)


def test_quality_model(labelled):
    docs, labels = labelled
    model = quality_model.train(docs, labels)
    assert 0 < len(model.rules) < 200
    assert held_out_accuracy(quality_model.scores(docs, model), labels, "quality") > 0.98


def test_toxicity_joins_spelled_words_with_swapped_letters():
    for text in (b"i d i o t", b"i d 1 0 t", b"1 d i 0 t", b"you I D 1 O 7 there", b"!d i d 1 0 t."):
        assert any(u.endswith(b"idiot") for u in toxicity.units(text)), (text, toxicity.units(text))
    assert toxicity.units(b"1 0 3") == {b"1", b"0", b"3"}


def test_toxicity_model(spark, labelled):
    docs, labels = labelled
    machine = toxicity.train(docs, labels)
    assert held_out_accuracy(toxicity.scores(docs, machine), labels, "toxic") > 0.97
    plain = sentence(random.Random(3), 50)
    tricks = ["i d i o t", "i.d.i.o.t", "idxiot", "1d10t", "grumblosk", "IDIOT!!"]
    rows = spark.createDataFrame([(i, f"{plain} {t} {plain}") for i, t in enumerate(tricks)] + [(99, plain), (100, None), (101, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(rows, machine).collect()}
    assert [got[i] for i in range(len(tricks))] == [1] * len(tricks) and got[99] == got[100] == got[101] == 0


def test_models_without_labels(spark, docs, nothing, labelled):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    q, t = quality_model.train(docs, none), toxicity.train(docs, none)
    assert {r["score"] for r in quality_model.scores(docs, q).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scores(docs, t).collect()} == {0.5}
    assert quality_model.scores(nothing, q).collect() == [] and toxicity.scores(nothing, t).collect() == []
    machine = toxicity.train(*labelled)
    assert toxicity.scores(nothing, machine).collect() == [] and len(toxicity.scores(docs, machine).collect()) == docs.count()


def kernel(a, b):
    """The subsequence kernel by its definition, scaled by what it is for a string of that length without repeats."""
    from itertools import combinations

    def phi(s):
        out, size = Counter(), 0.0
        letters = [0, *(int(toxicity._class[b]) for b in s), toxicity.LETTERS - 1]
        for x in combinations(range(len(letters)), 3):
            if x[2] - x[0] < toxicity.SPAN:
                w = toxicity.DECAY ** (x[2] - x[0] + 1)
                out[tuple(letters[i] for i in x)] += w
                size += w * w
        return {u: v / np.sqrt(size) for u, v in out.items()}

    p, q = phi(a), phi(b)
    return sum(p[u] * q.get(u, 0.0) for u in p)


def test_kernel_against_its_definition():
    words = [b"idiot", b"idxiot", b"banana", b"anna", b"thereabouts", b"a b", b"x"]
    rows, _ = toxicity.features(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(rows[i] @ rows[j] - kernel(a, b)) < 1e-5


def test_decisions_by_look_up_are_sums_over_landmarks():
    marks = [b"idiot", b"moron", b"hello there", b"banana"]
    nystroem = toxicity.Landmarks.of(marks)
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    rng = np.random.default_rng(4)
    w = rng.normal(size=nystroem.map.shape[1])
    machine = toxicity.Machine((nystroem.map @ w)[nystroem.place], -0.5)
    # The features' products are the Nyström approximation; on landmarks it is the kernel.
    z = nystroem.features(marks)
    assert np.allclose(np.stack([z[a] for a in marks]) @ np.stack([z[a] for a in marks]).T, k, atol=1e-4)
    for text in (b"idioot", b"some text hello idixot. Moron", b"", b"i d i o t", b"x" * 200):
        found = toxicity.units(text)
        want = max((float(toxicity.Landmarks.features(nystroem, [u])[u] @ w) for u in found), default=toxicity.FLOOR) - 0.5
        assert abs(machine.decisions([text])[0] - want) < 1e-4


def test_toxicity_learns_phrases_of_ordinary_words_and_gapped_insults(spark):
    rng = random.Random(14)
    words = ["you", "all", "are", "no", "good", "go", "away", "now", "we", "see", "the", "sun"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(40)]
        text = " ".join(w).replace("go away", "go now")
        toxic = rng.random() < 0.3
        if toxic:
            text = " ".join([*text.split(" ")[:20], rng.choice(["go away", "grumblo", "grum-blo", "gr.umblo"]), *text.split(" ")[20:]])
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, table)
    both = toxicity.scores(docs, machine).join(table, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r[0] == r[1] for r in both) / len(both) > 0.97
    probe = [("the sun now go away we see", 1), ("the sun now go. Away we see", 0), ("we see grumxblo now", 1), ("g r u m b l o", 1), ("GRUMBL0", 1), ("go see the sun away", 0)]
    got = by_id(toxicity.scores(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(probe)], "doc_id long, text string"), machine))
    assert [got[i]["predicted"] for i in range(len(probe))] == [y for _, y in probe]


def test_toxicity_learns_from_few_examples(spark):
    rows = [(i, f"plain words number {i}" + (" grumblo" if i % 5 == 0 else "")) for i in range(24)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    assert machine.prior is None
    assert [r["predicted"] for r in toxicity.scores(docs, machine).orderBy("doc_id").collect()] == [int(i % 5 == 0) for i, _ in rows]


def test_fingerprint_column_is_spark_native_hash(spark):
    rows = spark.createDataFrame([("a b c",)], "x string").select(F.xxhash64("x"))
    assert rows.first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c", seed=42)
