import random

import corpus_pipeline as pipeline
from wearline.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]


def similarity(a, b):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def made(rng, n, changed):
    """Two texts of n words with `changed` words, all far apart, replaced in the second."""
    base = words(rng, n)
    other = list(base)
    for i in range(changed):
        other[10 + i * 10] = "changed" + str(rng.random())[2:8]
    return " ".join(base), " ".join(other)


def band(s):
    return min(int(s * 20 + 1e-9), 19) / 20


def test_every_pair_from_the_threshold_on_is_found_and_no_other(spark):
    rng = random.Random(11)
    rows, want, count, kept = [], set(), {}, {}
    for k in range(320):
        a, b = made(rng, 200, 1 + k % 8)
        s = similarity(a, b)
        rows += [(2 * k, a, "en", "s", 1), (2 * k + 1, b, "en", "s", 1)]
        want |= {2 * k} | ({2 * k + 1} if s < 0.8 else set())
        count[band(s)] = count.get(band(s), 0) + 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, "").select("doc_id").collect()}
    for k in range(320):
        s = similarity(rows[2 * k][1], rows[2 * k + 1][1])
        kept[band(s)] = kept.get(band(s), 0) + (2 * k + 1 not in got)
    print("similarity from, pairs, linked:", [(b, count[b], kept[b]) for b in sorted(count)])
    assert got == want


def test_a_bucket_of_different_groups_is_compared_across(spark):
    rng = random.Random(5)
    base = words(rng, 400)
    rows = []
    for i in range(60):
        mine = list(base)
        for j in range(rng.randint(0, 9)):
            mine[rng.randrange(400)] = f"v{i}x{j}"
        rows.append((i, " ".join(mine), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    got = sorted(r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, "").select("doc_id").collect())
    assert got == sorted(i for i in range(60) if group.index(group[i]) == i)


def brute(texts, least=0.8):
    """Smallest index reachable by pairs of at least the similarity."""
    sets = [set(shingles.shingles(t.encode()).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = sets[i] == sets[j] or (both and both / len(sets[i] | sets[j]) >= least)
            if alike and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def family(rng, n, size, own):
    """Documents of one template of which `own` of `size` words at the end are each one's own."""
    template = words(rng, size - own)
    return [" ".join(template + [f"own{i}x{j}" for j in range(own)]) for i in range(n)]


def rooted(spark, texts, **limits):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    df = df.selectExpr("*", "1 fp", "'n' n", "2 sig", "3 bands", "4 root", "5 sim", "'k' k0", "'t' text")
    got = {r["i"]: r["root"] for r in shingles.groups(df, ["i"], "t", **limits).collect()}
    least = {}
    for i in sorted(got):
        least.setdefault(got[i], i)
    return [least[got[i]] for i in range(len(texts))]


def test_crowded_buckets_equal_comparing_all_pairs(spark):
    rng = random.Random(12)
    texts = family(rng, 30, 120, 14)  # below the threshold
    base = words(rng, 150)
    for i in range(50):  # around the threshold
        mine = list(base)
        for _ in range(rng.randint(0, 5)):
            mine[rng.randrange(150)] = f"v{i}x{rng.random()}"
        texts.append(" ".join(mine[: rng.randint(125, 150)]))
    texts += [texts[3], "", " ", "a b", "A b", None, texts[40] + " more"]
    want = brute([t or "" for t in texts])
    assert len(set(want[30:80])) > 3 and len(set(want[:30])) == 30
    for crowd in (0, 5, 64):
        assert rooted(spark, texts, crowd=crowd) == want


def test_pairs_of_a_template_family_follow_its_documents(spark):
    """At similarity 0.73 all pairs share bands; none of them is read again."""
    rng = random.Random(3)
    for n in (100, 400):
        texts = family(rng, n, 300, 45)
        sets = [shingles.shingles(t.encode()) for t in texts]
        assert 0.7 < shingles.jaccard(sets[0], sets[1]) < 0.76
        rows = [(i, i, len(s), t.encode()) for i, (s, t) in enumerate(zip(sets, texts, strict=True))]
        df = spark.createDataFrame(rows, "fp long, root long, n long, text binary").repartition(4)
        assert shingles.prefix_pairs(df, 5, 0.8).count() == 0
    assert len(set(rooted(spark, family(rng, 150, 300, 45)))) == 150


def test_simhash_links_alone_find_light_edits(spark):
    rng = random.Random(9)
    pairs = [made(rng, 400, 1) for _ in range(60)]
    sets = [t for p in pairs for t in p]
    fp = [shingles.majority(shingles.shingles(t.encode())) for t in sets]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fp)], "fp long, sim long")
    linked = {(r["a"], r["b"]) for r in shingles._simhash_pairs(df, 7).collect()}
    near = {(2 * i, 2 * i + 1) for i in range(60) if (fp[2 * i] ^ fp[2 * i + 1]).bit_count() <= 7}
    assert len(near) > 45 and near <= linked | {(b, a) for a, b in linked}


def test_short_and_empty_texts():
    assert len(shingles.shingles(b" \t")) == 0 and len(shingles.shingles(b"A b")) == 1
    assert list(shingles.shingles(b"A b c d e")) == list(shingles.shingles(b"a B c d E"))
    assert shingles.jaccard(shingles.shingles(b""), shingles.shingles(b"")) == 1.0
