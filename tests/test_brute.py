"""Queries that SQL doesn't express, against slow plain versions over whole small tables; and the EM steps they are made of."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import SMALL, connected

from seqloom.operators import cluster, em, kmers, learn, metrics, sampling, search
from seqloom.operators.motifs import Motif, divergence
from seqloom.plans import catalog
from seqloom.plans.model_queries import LIBRARY, UNIFORM
from seqloom.plans.registry import over_seqs
from seqloom.plans.scan_queries import BEST, HITS, LABELLED, MOTIFS

FLIP = str.maketrans("ACGT", "TGCA")


def run(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def db():
    return connected(SMALL)


@pytest.fixture(scope="module")
def seqs(db):
    return db.sql(over_seqs("SELECT seq_id, seq FROM seqs ORDER BY seq_id")).fetchall()


@pytest.fixture(scope="module")
def found(db):
    return db.sql(over_seqs("SELECT motif, seq_id, pos, reverse, width, seq_len FROM hits", *HITS)).fetchall()


def mirrored(s):
    return s.translate(FLIP)[::-1]


def tail_of_chi_square(x, freedom):
    """Closed forms for 7 and 8 degrees."""
    h = x / 2
    if freedom == 8:
        return math.exp(-h) * sum(h**k / math.factorial(k) for k in range(4))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (k + 0.5) / math.gamma(k + 1.5) for k in range(3))


def chi(counts, first, last):
    own = [counts.get(b, 0) for b in range(first, last)]
    present = [c for c in own if c]
    mean = sum(own) / (last - first)
    return sum(c * c for c in present) / mean - sum(own) if mean else 0.0


def test_f07_bias_significance(spark, db, seqs, found):
    rank = {i: k for k, (i, _) in enumerate(seqs)}
    best = db.sql(over_seqs("SELECT motif, seq_id, score FROM best", *BEST)).fetchall()
    for r in run(spark, "f07_bias_significance"):
        own = [(pos, back, width, n) for m, _, pos, back, width, n in found if m == r.motif]
        bins, ranks = {}, {}
        for pos, _, width, n in own:
            b = 10 * ((pos + width // 2) % n) // n
            bins[b] = bins.get(b, 0) + 1
        for m, i, score in best:
            if m == r.motif and score >= -5:
                b = 10 * rank[i] // len(seqs)
                ranks[b] = ranks.get(b, 0) + 1
        n, back = len(own), sum(b for _, b, _, _ in own)
        upper = sum(math.comb(n, k) for k in range(back, n + 1))
        strand = min(1.0, 2 * min(upper / 2**n, 1 - (upper - math.comb(n, back)) / 2**n)) if n < 1000 else None
        assert r.p_position == pytest.approx(tail_of_chi_square(chi(bins, 1, 9), 7), abs=1e-9)
        assert r.p_rank == pytest.approx(tail_of_chi_square(chi(ranks, 0, 9), 8), abs=1e-9)
        if strand is None:
            lower = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(back))
            at = math.exp(math.lgamma(n + 1) - math.lgamma(back + 1) - math.lgamma(n - back + 1) - n * math.log(2))
            strand = min(1.0, 2 * min(1 - lower, lower + at))
        assert r.p_strand == pytest.approx(strand, abs=1e-7)


def test_a31_decay_fit(spark, found):
    """No nearby curve fits better."""
    for r in run(spark, "a31_decay_fit"):
        bins = {}
        for m, _, pos, _, width, n in found:
            if m == r.motif:
                b = min(math.floor(abs(pos + width / 2 - n / 2) / (n / 2) * 50), 49)
                bins[b] = bins.get(b, 0) + 1
        cost = lambda a, b, c: sum((n - a * math.exp(-b * x) - c) ** 2 for x, n in bins.items())
        best = cost(r.a, r.b, r.c)
        for step in (1e-3, 1e-2):
            for move in itertools.product((-1, 0, 1), repeat=3):
                assert best <= cost(*(v + d * step * max(abs(v), 0.1) for v, d in zip((r.a, r.b, r.c), move))) * (1 + 1e-9) + 1e-9


def naive_clusters(d, linkage, cut):
    """Merges by the distances of the items themselves."""
    between = {"SINGLE": min, "COMPLETE": max, "UPGMA": lambda x: sum(x) / len(x)}[linkage]
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        near, i, j = min((between([d[a][b] for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        if near > cut:
            break
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
        groups.sort()
    return sorted(groups)


def test_c03_hierarchical_clusters(spark):
    got = {}
    for r in run(spark, "c03_hierarchical_clusters"):
        got.setdefault(r.linkage, {}).setdefault(r.cluster, set()).add(r.motif)
    d = [[0.0 if a is b else divergence(a, b) for b in LIBRARY] for a in LIBRARY]
    for linkage in ("SINGLE", "COMPLETE", "UPGMA"):
        wanted = [{LIBRARY[i].name for i in g} for g in naive_clusters(d, linkage, 0.3)]
        assert sorted(map(sorted, got[linkage].values())) == sorted(map(sorted, wanted))
    assert set(got) == {"SINGLE", "COMPLETE", "UPGMA", "WPGMA", "UPGMC", "WPGMC", "WARD"} and all(set().union(*c.values()) == {m.name for m in LIBRARY} for c in got.values())


def test_linkages_on_a_plane():
    """Centroid and Ward linkages are distances of centres, which points on a plane have."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (5, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for linkage in ("UPGMC", "WARD", "WPGMC", "WPGMA"):
        assert cluster.hierarchical(d, linkage, 2.0) == [list(range(5)), list(range(5, 10)), list(range(10, 15))]


def slow_walk(model, order, seed, seq_id, n):
    s, prime = "", (1 << 31) - 1
    for i in range(n):
        x = (seq_id % prime * 48271 + i * 69621 + seed * 16807 + 1) % prime
        for factor, shift in ((950706376, 12345), (1226874159, 7), (62089911, 99991)):
            x = (x * x + x * factor % prime + shift) % prime
        context = s[-order:] if order else ""
        upto = np.cumsum([model[context + b] for b in "ACGT"])
        s += "ACGT"[min(sum(x / prime * upto[3] >= c for c in upto[:3]), 3)]
    return s


def model_of(db, order):
    from seqloom.plans.sequence_queries import model_sql

    return dict(db.sql(over_seqs("SELECT prefix, p FROM model", model_sql(order))).fetchall())


def test_r01_markov_sequences(spark, db, seqs):
    model = model_of(db, 2)
    got = {r.seq_id: r.seq for r in run(spark, "r01_markov_sequences")}
    assert {i: len(s) for i, s in got.items()} == {i: len(s) for i, s in seqs}
    for i, s in seqs[::7]:
        assert got[i][:400] == slow_walk(model, 2, 5, i, min(len(s), 400))
    pairs = "".join(got.values())
    for context in ("AA", "TG"):  # letters come as often as the model says
        after = [pairs[m.start() + 2] for m in re.finditer(f"(?={context}.)", pairs)]
        assert all(abs(after.count(b) / len(after) - model[context + b]) < 0.05 for b in "ACGT")


def test_r04_background_sets(spark, db, seqs):
    import hashlib

    model, lengths = model_of(db, 1), dict((i, len(s)) for i, s in seqs)
    got = {r.seq_id: (r.len, r.seq_md5) for r in run(spark, "r04_background_sets")}
    assert {i: n for i, (n, _) in got.items()} == {2 * i + k: n for i, n in lengths.items() for k in (0, 1)}
    short = [i for i, (n, _) in sorted(got.items()) if n < 300][:30]
    assert short and all(got[i][1] == hashlib.md5(slow_walk(model, 1, 21, i, got[i][0]).encode()).hexdigest() for i in short)


def slow_expected(rows, state, mode, flank=0):
    """The E-step by loops over windows; rows: (sequence, weight, chance of each letter to be free)."""
    w = state.motif.weights / state.motif.weights.sum(axis=1, keepdims=True)
    width, counts, sites = len(w), np.zeros((len(w) + 2 * flank, 4)), 0.0
    for s, weight, free in rows:
        places = range(len(s) - width + 1)
        ratio = {}
        for p in places:
            for back in (False, True):
                site = mirrored(s[p : p + width]) if back else s[p : p + width]
                x = math.prod(float(w[c, "ACGT".index(b)] / 0.25) for c, b in enumerate(site) if b in "ACGT") * math.prod(free[p : p + width])
                ratio[p, back] = min(x, math.exp(em.CAP)) * state.share / 2 / (len(places) if mode == "one" else 1)
        whole = 1 - state.share + sum(ratio.values())
        for (p, back), x in ratio.items():
            z = weight * x / (whole if mode == "one" else 1 - state.share + ratio[p, False] + ratio[p, True])
            sites += z
            for c in range(-flank, width + flank):
                at = p + width - 1 - c if back else p + c
                if 0 <= at < len(s):
                    b = s[at].translate(FLIP) if back else s[at]
                    counts[c + flank] += z * (np.array([b == x for x in "ACGT"], dtype=float) if b in "ACGT" else 0.25)
    return counts, sites


@pytest.mark.parametrize("mode", ["one", "any"])
def test_expected_counts(spark, mode):
    rng = random.Random(6)
    state = em.State(Motif.of_consensus("x", "TAATTA", 0.7), 0.3)
    rows = [("".join(rng.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(rng.randint(3, 60))), rng.uniform(0.5, 2)) for i in range(25)]
    erased = [[{"pos": 4, "width": 6, "z": 0.75}, {"pos": 7, "width": 3, "z": 0.5}] if len(s) > 20 else None for s, _ in rows]
    free = []
    for (s, _), sites in zip(rows, erased):
        free.append([math.prod(1 - x["z"] for x in sites or [] if x["pos"] <= i < x["pos"] + x["width"]) for i in range(len(s))])
    schema = "seq_id long, seq string, w double, erased array<struct<pos:int,width:int,z:double>>"
    frame = spark.createDataFrame([(i, s, w, e) for i, ((s, w), e) in enumerate(zip(rows, erased))], schema)
    for flank, erase in ((0, False), (2, False), (0, True)):
        counts, sites, _ = em.expected_counts(frame, [state], UNIFORM, mode, flank, "w", "erased" if erase else None)["x"]
        wanted, n = slow_expected([(s, w, f if erase else [1.0] * len(s)) for (s, w), f in zip(rows, free)], state, mode, flank)
        assert np.allclose(counts, wanted, atol=1e-6) and abs(sites - n) < 1e-6  # scores are rounded to 9 decimals


def fitted(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.motif, r.col)):
        out.setdefault(r.motif, []).append((r.a, r.c, r.g, r.t))
    return {k: np.array(v) for k, v in out.items()}


def slow_rounds(rows, motif, rounds, mode="one", free=None):
    state = em.State(motif)
    for _ in range(rounds):
        counts, sites = slow_expected([(s, 1.0, f) for s, f in zip(rows, free or [[1.0] * len(s) for s in rows])], state, mode)
        counts = counts + 0.25
        state = em.State(Motif(motif.name, counts / counts.sum(axis=1, keepdims=True)), min(max(sites / len(rows), 1e-6), 1 - 1e-6))
    return state


def planted(rng, n, site, share, size=60):
    rows = []
    for _ in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(size))
        if rng.random() < share:
            at = rng.randrange(size - len(site))
            s = s[:at] + (site if rng.random() < 0.5 else mirrored(site)) + s[at + len(site) :]
        rows.append(s)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq_id long, seq string")


def test_e01_extending_em(spark):
    got = fitted(run(spark, "e01_extending_em"))
    assert len(got) == 3 and all(np.allclose(w.sum(axis=1), 1, atol=1e-4) and 6 <= len(w) <= 12 for w in got.values())
    rows = frame_of(spark, planted(random.Random(1), 300, "GATTACAGCC", 0.8))
    wide = em.extend(rows, [em.State(Motif.of_consensus("x", "TTACAG", 0.7))], UNIFORM, rounds=8, most=14)
    best = em.fit(rows, wide, UNIFORM, rounds=6)[0].motif.best()
    assert "GATTACAGCC" in best or "GATTACAGCC" in mirrored(best)


def test_e02_resampled_em(spark, tmp_path):
    got = fitted(run(spark, "e02_resampled_em"))["m2"]
    assert got.shape == (7, 4) and np.allclose(got.sum(axis=1), 1, atol=1e-4)

    def keep(rows):
        path = str(tmp_path / f"sample{len(list(tmp_path.iterdir()))}")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    rows = planted(random.Random(2), 200, "GATTACAGGC", 0.9)
    seed = Motif.of_consensus("x", "GATTACA", 1.0)
    assert np.allclose(em.diluted(seed).weights.max(axis=1), em.DILUTED_SHORT)
    state, rounds = em.resampled(frame_of(spark, rows), seed, UNIFORM, keep, ratio=0.1, least=500)
    assert state.motif.best() == "GATTACA" and state.motif.weights.max(axis=1).min() > 0.8 and 1 < rounds <= 51
    whole = em.fit(frame_of(spark, rows), [em.State(em.diluted(seed), 0.01)], UNIFORM, rounds=20, mode="any")[0]
    assert np.abs(whole.motif.weights - state.motif.weights).max() < 0.15
    assert em.resampled(frame_of(spark, ["AC"]), seed, UNIFORM, keep)[1] == 0


def test_e06_erasing_em(spark):
    got = fitted(run(spark, "e06_erasing_em"))
    assert set(got) == {"first", "second"} and all(np.allclose(w.sum(axis=1), 1, atol=1e-4) for w in got.values())
    rng = random.Random(3)
    rows = planted(rng, 40, "TAATTA", 0.7, 40)
    first = slow_rounds(rows, Motif.of_consensus("first", "TAATTA", 0.7), 2)
    frame = frame_of(spark, rows)
    same = em.fit(frame, [em.State(Motif.of_consensus("first", "TAATTA", 0.7))], UNIFORM, rounds=2)[0]
    assert np.allclose(first.motif.weights, same.motif.weights, atol=1e-6)
    found = em.sites(frame, same, UNIFORM)
    free = [[1.0] * len(s) for s in rows]
    for r in found.collect():
        for i in range(r.pos, r.pos + r.width):
            free[r.seq_id][i] *= 1 - r.z
    second = slow_rounds(rows, Motif.of_consensus("second", "AATTAC", 0.7), 2, free=free)
    erased = em.fit(em.erasing(frame, found), [em.State(Motif.of_consensus("second", "AATTAC", 0.7))], UNIFORM, rounds=2, erased="erased")[0]
    assert np.allclose(second.motif.weights, erased.motif.weights, atol=1e-6)


def test_e07_hill_climb(spark, db):
    """No change of one column is better."""
    counts = db.sql(over_seqs("SELECT substr(seq, p + 1, 6) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(0, length(seq) - 5)) AS p FROM seqs) GROUP BY 1")).fetchall()
    total, q = sum(n for _, n in counts), model_of(db, 0)

    def z(columns):
        hits = sum(n for k, n in counts if all(b in c for b, c in zip(k, columns)))
        p = math.prod(sum(q[b] for b in c) for c in columns)
        return (hits - total * p) / math.sqrt(total * p * (1 - p))

    rows = sorted(run(spark, "e07_hill_climb"), key=lambda r: r.col)
    columns = [r.bases for r in rows]
    assert rows[0].z == pytest.approx(z(columns), abs=1e-5) and z(columns) >= z(list("TAATTA"))
    assert all(z([*columns[:i], s, *columns[i + 1 :]]) <= z(columns) + 1e-9 for i in range(6) for s in search.SUBSETS)


def test_e08_merged_motifs(spark):
    got = next(iter(fitted(run(spark, "e08_merged_motifs")).values()))
    a, b = LIBRARY[0].weights, LIBRARY[3].weights  # TAATTA within TAATTAA, at its start
    wanted = np.zeros((7, 4))
    wanted[:6] += 2 * a
    wanted += b
    assert np.allclose(got, wanted / wanted.sum(axis=1, keepdims=True), atol=1e-6)


def test_e09_logistic_combiner(spark, db):
    rows = db.sql(over_seqs("SELECT seq_id, any_value(label) AS y, " + ", ".join(f"max(score) FILTER (motif = '{m.name}') AS {m.name}" for m in MOTIFS) + " FROM labelled GROUP BY seq_id HAVING m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL", *LABELLED)).fetchall()
    x, y = np.array([[*r[2:], 1.0] for r in rows]), np.array([r[1] for r in rows])
    got = {r.term: r.weight for r in run(spark, "e09_logistic_combiner")}
    w = np.array([got[t] for t in ("m1", "m2", "m3", "intercept")])
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-3 * w  # which is nothing at the maximum
    assert np.abs(gradient).max() < 1e-2


def test_e09_negative_binomial_mixture(spark):
    parts = run(spark, "e09_negative_binomial_mixture")
    assert len(parts) == 2 and sum(p.share for p in parts) == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.negative_binomial(6, 0.6, 3000), rng.negative_binomial(20, 0.3, 2000)])
    (s1, r1, p1), (s2, r2, p2) = em.negative_binomial_mixture(spark.createDataFrame([(int(v),) for v in values], "n long"), "n", rounds=60)
    assert abs(s1 - 0.6) < 0.04 and abs(r1 * (1 - p1) / p1 - 4) < 0.5 and abs(r2 * (1 - p2) / p2 - 46.7) < 3
    assert em.negative_binomial_mixture(spark.createDataFrame([], "n long"), "n") == []


def test_e11_smoothed_flank(spark, db):
    """The sum over all paths of bases."""
    model, m = model_of(db, 1), MOTIFS[1]
    total = np.zeros((len(m), 4))
    for path in itertools.product(range(4), repeat=len(m)):
        p = model["ACGT"[path[0]]] * m.weights[0, path[0]]
        for i in range(1, len(m)):
            p *= model["ACGT"[path[i - 1]] + "ACGT"[path[i]]] * m.weights[i, path[i]]
        total[range(len(m)), path] += p
    got = np.array([(r.a, r.c, r.g, r.t) for r in sorted(run(spark, "e11_smoothed_flank"), key=lambda r: r.col)])
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_c06_dependency_groups(spark, seqs):
    """Every way of choosing disjoint groups."""
    m = MOTIFS[2]
    score = lambda s: sum(m.logs[c, "ACGT".index(b)] for c, b in enumerate(s))
    sites = []
    for _, s in seqs:
        for p in range(len(s) - len(m) + 1):
            w = s[p : p + len(m)]
            f, r = round(score(w), 9), round(score(mirrored(w)), 9)
            if max(f, r) >= -8:
                sites.append(mirrored(w) if r > f else w)
    worth = {}
    for k in (2, 3):
        for g in itertools.combinations(range(len(m)), k):
            words = {}
            for s in sites:
                w = "".join(s[c] for c in g)
                words[w] = words.get(w, 0) + 1
            rows = sorted(((n, w) for w, n in words.items()), key=lambda r: (-r[0], r[1]))
            q = lambda w: math.prod(sum(s[c] == b for s in sites) / len(sites) for c, b in zip(g, w))
            parts = [(n / len(sites), q(w)) for n, w in rows[:7]]
            if rows[7:]:
                parts.append((sum(n for n, _ in rows[7:]) / len(sites), sum(q(w) for _, w in rows[7:])))
            worth[g] = sum(p * math.log(p / x) for p, x in parts) - 0.01 * (k - 1)
    pairs = {g for g, x in worth.items() if len(g) == 2 and x > 0}
    usable = {g: x for g, x in worth.items() if x > 0 and (len(g) == 2 or all(p in pairs for p in itertools.combinations(g, 2)))}

    def best(groups, used):
        top = 0.0
        for i, g in enumerate(groups):
            if not used & set(g) and len(used) + len(g) <= 6:
                top = max(top, usable[g] + best(groups[i + 1 :], used | set(g)))
        return top

    got = {tuple(map(int, r.columns.split("-"))): r.score for r in run(spark, "c06_dependency_groups")}
    assert all(x == pytest.approx(usable[g], abs=1e-5) for g, x in got.items())
    assert sum(got.values()) == pytest.approx(best(sorted(usable), set()), abs=1e-4)
    assert len({c for g in got for c in g}) == sum(map(len, got)) <= 6


def test_c11_column_learning(spark):
    """Rows that the forest hasn't seen; well apart, they are all found."""
    import zlib

    got = run(spark, "c11_column_learning")
    held = [i for (i,) in duckdb.sql(f"SELECT vec_id FROM '{SMALL}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall() if zlib.crc32(str(i).encode()) % 4 == 0]
    assert sum(r.n for r in got) == len(held) and all(r.n_right <= r.n for r in got)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(8.0 * (i % 3), 0.5, 6).tolist()) for i in range(150)]
    frame = learn.column_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding")
    model = learn.train(frame.where("vec_id % 4 <> 0"), "embedding", "cluster")
    judged = learn.predict(model, frame.where("vec_id % 4 = 0"), "embedding").collect()
    assert len({r.cluster for r in judged}) == 3 and all(r.predicted == r.cluster for r in judged)


def test_profiles(spark):
    """Sets of motifs by loops over places."""
    rng = random.Random(8)
    rows = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (50, 5, 0, 8, 120)]
    motifs = MOTIFS[:2]
    for strands in (False, True):
        got = {(r.motifs, r.seq_id): r.score for r in cluster.profile_scores(frame_of(spark, rows), motifs, 4, strands).collect()}
        wanted = {}
        for i, s in enumerate(rows):
            tops = {}
            for m in motifs:
                score = lambda w: sum(m.logs[c, "ACGT".index(b)] for c, b in enumerate(w))
                starts = range(len(s) - len(m) + 1)
                both = [[score(s[p : p + len(m)]) for p in starts], [score(mirrored(s[p : p + len(m)])) for p in starts]]
                sides = both if strands else [[max(x) for x in zip(*both)]]
                tops[m.name] = [[max((v[q] for q in starts if abs(q - p) <= 4), default=-math.inf) for p in range(len(s))] for v in sides]
            for names in (["m1"], ["m2"], ["m1", "m2"]):
                best = max((sum(tops[n][k][p] for n in names) for k in range(2 if strands else 1) for p in range(len(s))), default=-math.inf)
                if best > -math.inf:
                    wanted["+".join(names), i] = best
        assert set(got) == set(wanted) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in wanted.items())


def test_windows_of_a_whole_spread(spark):
    rows = spark.createDataFrame([("m", i / 1000) for i in range(1000)], "motif string, away double")
    assert all(abs(r.odds - 1) < 0.06 for r in metrics.geometric_windows(rows).collect())


def test_postings(spark):
    rows = frame_of(spark, ["ACGTACG", "TACG", "AC"])
    got = {(r.kmer, r.block): [tuple(p) for p in r.places] for r in kmers.postings(rows, 3, span=1).collect()}
    assert got["ACG", 0] == [(0, 0), (0, 4)] and got["TAC", 1] == [(1, 0)] and ("ACG", 2) not in got


def test_draws(spark):
    from pyspark.sql import functions as F

    frame = spark.range(2000)
    numbers = [r.u for r in frame.select(sampling.uniform(3, "id").alias("u")).orderBy("id").collect()]
    assert numbers[:50] == [sampling.draw(3, i) for i in range(50)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.0)], "kind string, w double")
    got = [r.kind for r in sampling.inverse(frame, sampling.uniform(3, F.col("id")), weights, "kind", "w").orderBy("id").collect()]
    assert got == ["a" if u < 0.25 else "c" for u in numbers]
    x = sampling._numbers(1, np.arange(20000), 3)
    assert abs(x.mean() - 0.5) < 0.01 and abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.03 and len(np.unique(x)) > 19990


def test_scan_sites(spark):
    from seqloom.operators import scan

    rows = frame_of(spark, ["ACGTNNACGATTAC", "TTGATTACA"])
    found = scan.scan(rows, [MOTIFS[0]], -20.0, sites=True).collect()
    text = dict(enumerate(["ACGTNNACGATTAC", "TTGATTACA"]))
    assert found and all(r.site == text[r.seq_id][r.pos : r.pos + 6] for r in found)
    assert pa.array([r.site for r in found]).null_count == 0
