"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random

import corpus_pipeline
import numpy as np
import xxhash
from helpers import awkward, docs, prose

from changelens.llm import components, near_copies, op9_simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    k = min(near_copies.WIDTH, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_kept(rows):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(min((d for d in v if d is not None), default=None) for v in least.values())


def edited():
    r, out = random.Random(6), ["", None, " \n", "one two", "one two"]
    for s in range(12):
        words = prose(200, s).split()
        for n in (0, 1, 2, 3, 4, 5, 9):
            copy = list(words)
            for at in r.sample(range(200), n):
                copy[at] = f"edit{r.random()}"
            out.append(" ".join(copy))
    return out


def test_edited_copies_are_found(spark):
    for df in (docs(spark, edited()), awkward(docs(spark, edited()))):
        want = plain_kept([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        kept = corpus_pipeline.near_duplicates(spark, df, "")
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < op9_simhash.one_per_group(df).count()
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def planted(n_groups, n_copies, n_words=150):
    """Texts, and pairs (i, j) with a similarity of 0.8 or more to the first of their group."""
    r, texts, pairs = random.Random(8), [], []
    for g in range(n_groups):
        words = [f"w{r.randrange(10**6)}" for _ in range(n_words)]
        first = len(texts)
        texts.append(" ".join(words))
        own = plain_set(texts[first])
        for _ in range(n_copies):
            copy = list(words)
            for at in r.sample(range(n_words), r.randint(1, 3)):
                copy[at] = f"edit{r.randrange(10**9)}"
            texts.append(" ".join(copy))
            other = plain_set(texts[-1])
            if len(own & other) >= 0.8 * len(own | other):
                pairs.append((first, len(texts) - 1))
    return texts, pairs


def roots_of(spark, texts):
    df = docs(spark, texts)
    found = near_copies.stored(near_copies.signatures(df), "signatures")
    return {r.k1: r.root for r in found.join(near_copies.groups(df, found), "fp").select("k1", "root").collect()}


def test_recall_on_thousands_of_planted_pairs(spark):
    texts, pairs = planted(400, 8)
    assert len(pairs) > 2000
    root = roots_of(spark, texts)
    assert sum(root[i] == root[j] for i, j in pairs) >= 0.999 * len(pairs)
    assert len(set(root.values())) >= 400


def test_one_large_group_of_near_copies_and_boilerplate(spark):
    texts, pairs = planted(1, 2000)
    shared = prose(100, 5)  # unlike documents that share two thirds of their text: below the similarity
    unlike = [f"{shared} {' '.join(f'u{i}x{k}' for k in range(50))}" for i in range(200)]
    root = roots_of(spark, texts + unlike)
    assert sum(root[i] == root[j] for i, j in pairs) >= 0.999 * len(pairs)
    assert len({root[len(texts) + i] for i in range(200)}) == 200


def plain_bits(text):
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), 5) for x in plain_set(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_the_pigeonhole_search_links_without_minhash(spark, monkeypatch):
    r, texts = random.Random(4), ["", None, "one two", "one two three"]
    for s in range(25):
        words = prose(300, s).split()
        for n in (0, 1, 2, 6):
            copy = list(words)
            for at in r.sample(range(300), n):
                copy[at] = f"edit{r.random()}"
            texts.append(" ".join(copy))
    sets, bits = [plain_set(t) for t in texts], [plain_bits(t) for t in texts]
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j) and (bits[i] ^ bits[j]).bit_count() <= near_copies.TAU]
    monkeypatch.setattr(near_copies, "LEVELS", 0)
    root = roots_of(spark, texts)
    # a forest of the close ones is checked: a link of it that is not alike may stand for one that is, which MinHash finds
    assert len(pairs) > 40 and sum(root[i] == root[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert len(set(root.values())) >= 25
    monkeypatch.undo()
    whole = roots_of(spark, texts)
    assert all(whole[i] == whole[j] for i, j in pairs)


def test_merged_components_are_those_of_all_links(spark, monkeypatch):
    r, rounds, root = random.Random(9), [], {}
    turns = [[(r.randrange(300), r.randrange(300)) for _ in range(60)] + [(i, i + 1) for i in range(400, 410)], [(r.randrange(300), 405 + i) for i in range(9)] + [(5, 5)]]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    star = components.components(frame([]))
    large = components._large
    for links in turns:
        star = components.merged(star, frame(links))
        for a, b in links:
            a, b = root.setdefault(a, {a}), root.setdefault(b, {b})
            if a is not b:
                a |= b
                for x in b:
                    root[x] = a
        assert {(x.a, x.b) for x in star.collect()} == {(x, min(s)) for x, s in root.items() if x != min(s)}
    monkeypatch.setattr(components, "_large", lambda e: (rounds.append(1), large(e))[1])
    assert components.components(star).count() == star.count() and not rounds  # stars need no turn
    assert components.merged(star, frame([(x.b, x.a) for x in star.collect()])) is star and not rounds  # nor do links inside components


def test_no_link_is_lost_among_documents_just_below_the_similarity(spark):
    r, texts = random.Random(1), []
    shared = [f"c{i}" for i in range(176)]
    for i in range(100):  # two and two are alike (0.85), all others share almost as much (0.78)
        both = [f"b{i}x{k}" for k in range(8)]
        texts += [" ".join([*shared, *both, *(f"u{i}x{s}x{k}" for k in range(16))]) for s in range(2)]
    for i in range(40):  # sizes apart as far as they may be
        words = [f"w{i}x{k}" for k in range(r.randint(5, 60))]
        texts += [" ".join(words), " ".join([*words, *(f"v{i}x{k}" for k in range(len(words) // 4 - r.randint(0, 1)))])]
    root, sets = roots_of(spark, texts), [plain_set(t) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    least = list(range(len(texts)))
    for i, j in alike:
        least = [least[j] if x == least[i] else x for x in least]
    assert len(alike) > 100 and len(set(least)) == len({(root[i], least[i]) for i in range(len(texts))}) == len(set(root.values()))


def test_sets_at_the_similarity_share_one_of_their_first_shingles():
    r = np.random.default_rng(3)
    for n in [*range(1, 40), 400]:
        pool = np.unique(r.integers(0, 2**63, 2 * n + 9).astype(np.uint64))
        listed = np.sort(r.choice(pool, len(pool) // 3, replace=False))
        for often in (r.integers(3, 9, len(listed)), np.zeros(len(listed), int)):
            order = r.permutation(pool)
            for cut in range(n // 5 + 2):  # n in common or fewer, the rest on one side or on both
                a, b = np.sort(order[: n - cut // 2]), np.sort(np.concatenate([order[: n - cut], order[n : n + cut // 2]]))
                if len(a) and len(b) and near_copies.jaccard(a, b) >= near_copies.JACCARD:
                    assert len(np.intersect1d(near_copies.first_shingles(a, listed, often), near_copies.first_shingles(b, listed, often)))
    assert len(near_copies.first_shingles(np.zeros(0, np.uint64), listed, often)) == 0
