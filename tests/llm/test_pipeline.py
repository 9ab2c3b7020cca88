import random

import xxhash

import corpus_pipeline
from tickloom.llm.tables import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_the_small_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_stages_keep_odd_rows_and_empty_tables(spark):
    sf_dir, rng = "/root/testdata/sf0.001", random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(200))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "no id here", "en", "a", 1), (5, text.replace("7", "x", 2), "en", "b", 1), (6, "fine words", "en", "b", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 3, 6]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).count() > 0


def test_stages_begin_on_heaps_that_have_given_back_what_was_left(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [beans[i] for i in range(len(beans)) if beans[i].getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact")]
    docs = spark.createDataFrame([(1, "a text", "en", "a", 6)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in whole)
        stage(spark, docs, "/root/testdata/sf0.001")
        assert sum(b.getCollectionCount() for b in whole) > before, name


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def fingerprints(text):
    w = text.split(" ")
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 2]), seed=42) for k in range(max(1, len(w) - 1))]
    return [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in g) > len(g)) for g in (h, [mixed((x + 1) % 2**64) for x in h])]


def test_near_copies_are_those_that_fingerprints_link(spark):
    rng, texts = random.Random(2), []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 30, 120]))]
        for edits in (0, 0, 1, 2, 4, 8, 16):
            texts.append(" ".join(f"edit{rng.random()}" if k in rng.sample(range(len(words)), min(edits, len(words))) else w for k, w in enumerate(words)))
    rng.shuffle(texts)
    codes, label = [fingerprints(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if min((x ^ y).bit_count() for x, y in zip(codes[a], codes[b], strict=True)) <= corpus_pipeline.NEAR_BITS and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    again = [(0, texts[0], "en", "a", 1), (len(rows), texts[0], "en", "a", 1), (len(rows), "a text of its own under an id that comes twice", "en", "a", 1), (None, texts[0], "en", "a", 1)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows + again, COLUMNS), "").collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, *sorted(set(label)), len(rows)]
    assert 40 < len(set(label)) < 200


def test_near_copies_are_found_at_the_similarity_they_are_meant_for(spark):
    # Lone pairs at a 5-word Jaccard similarity of 0.8 and a little more, by edits dealt over the text.
    rng, texts = random.Random(5), []
    while len(texts) < 600:
        words = [f"w{rng.randrange(20_000)}" for _ in range(250)]
        other = list(words)
        for _ in range(rng.randint(4, 7)):
            other[rng.randrange(250)] = f"edit{rng.random()}"
        x, y = ({tuple(w[k : k + 5]) for k in range(246)} for w in (words, other))
        if 0.8 * len(x | y) <= len(x & y) <= 0.83 * len(x | y):
            texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert set(range(0, 600, 2)) <= kept and len(kept) <= 330


def join_rows(spark):
    """Most rows that each SQL execution so far has had out of a join, by its number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    listed = store.executionsList()
    for e in (listed.apply(i) for i in range(listed.size())):
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                said = values.get(m.accumulatorId())
                if "Join" in node.name() and m.name() == "number of output rows" and said.isDefined():
                    out[e.executionId()] = max(out.get(e.executionId(), 0), int(said.get().replace(",", "")))
    return out


def test_near_copies_of_one_template_do_not_meet_in_pairs(spark):
    # Any two texts have about 0.78 of their 5-word shingles in common, and there are 45,000 pairs.
    rng = random.Random(3)
    template = [f"w{rng.randrange(10**6)}" for _ in range(171)]
    texts = [" ".join(template[:86] + [f"own{rng.random()}" for _ in range(19)] + template[86:]) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], COLUMNS)
    before = set(join_rows(spark))
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() >= 1
    seen = [rows for e, rows in join_rows(spark).items() if e not in before]
    assert seen and max(seen) <= len(texts)
