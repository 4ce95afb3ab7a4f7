"""Operators against brute force, libraries, SQL and held-out labels."""

import itertools
import random
import re
import time

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from brute import brute_spans, united
from oracle import same

from seqloom.llm import decontam, e8, flattext, langid, lattice, license_scan, pii, piece, quality, queries, rollup, simhash, toxicity
from seqloom.llm.components import components

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_base_spans():
    rng = random.Random(1)
    parts = ["a", ".", "@", "1", "5", "-", " ", "+", "(", "256", "4111111111111111", "b.c", "é"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text)


def test_added_spans():
    own = pii.model()
    base, more = pii.all_spans("write to bob (at) mail1 dot com or tel (020) 794-6000, see version 1.2.3.4567 of 2024-01-02", own)
    assert base == [] and {k for k, _, _ in more} == {"email", "phone"} and len(more) == 2
    text = "mail a@b.cd, ip 10.0.0.1"
    assert pii.redacted(text, pii.base_spans(text)) == "mail [EMAIL], ip [IP]"
    held = [(t, s) for t, s in pii.examples(600, 99)]
    wrong = sum(1 for t, s in held for x in own.added(t, pii.base_spans(t)) if x not in s and not any(x[1] < b and a < x[2] for _, a, b in s))
    assert wrong <= 0.05 * len(held)


def encoded(texts):
    own, out, back = piece.codec(piece.default_model()), [], []
    for _, _, data, offsets in flattext.chunks(flattext.filled(pa.array(texts, pa.string()))):
        ids, limit = own.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(limit[:-1], limit[1:])]
        body, at = own.decode(ids, limit)
        raw = body.tobytes()
        back += [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])]
    return out, back


def test_pieces_equal_the_library():
    rng = random.Random(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece.default_model())
    signs = [*"abcdefghiklmnorst ETAO.,-_=#\n  ", "é", "ü", "日", "▁", "\t", "😀", "the", "ing", "tion", "   ", "ab", "aa", "\x00"]
    texts = ["", None, " ", "a\x00b", "▁x", "\n\na", "</s> <s><0x0A>", "a" * 3000, "ab" * 500, " " * 77]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    ids, back = encoded(texts)
    for t, i, b in zip(texts, ids, back):
        assert i == sp.encode(t or "", add_eos=True) and b == sp.decode(i)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "Ab c\n😀"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in piece.decode(piece.encode(docs)).collect()} == {1: "Ab c\n😀", 2: ""}


def test_simhash_links(spark, monkeypatch):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    for _ in range(300):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    mask = (1 << 64) - 1
    wanted = united(sorted(signed), lambda x, y: ((x ^ y) & mask).bit_count() <= 2)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (64, 2):  # by pairs, and by the dense way
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        edges = simhash.links(frame)
        found = {r.node: r.component for r in components(edges).collect()}
        assert {x: found.get(x, x) for x in signed} == wanted


def test_fingerprint():
    import xxhash

    def slow(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    for text in ("", " ", "One", "One two", "A b c d e f G", "É x   y\tz\n q", "a " * 500):
        assert simhash.fingerprint(text.encode()) & ((1 << 64) - 1) == slow(text)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    linked = {frozenset(p) for p in pairs}
    nodes = sorted({x for p in pairs for x in p if len(set(p)) == 2})
    wanted = united(nodes, lambda x, y: frozenset((x, y)) in linked)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_rounds(spark, monkeypatch):
    """The driver keeps the plan of each job: no round for stars, and few joins in a job where nodes have many edges."""
    from seqloom.llm import components as module

    plans = []

    def seen(df, purpose, write=module.written):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(module, "written", seen)
    stars = [(100 * i, 100 * i + j) for i in range(-2, 3) for j in range(1, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {x: x // 100 * 100 for x in range(-200, 300)} and len(plans) == 1
    hub = -(1 << 63)
    pairs = [(hub, i) for i in range(200)] + [(50, i) for i in range(150, 400)] + [(500, i) for i in range(501, 700)] + [(-9, 500), (-9, -8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: hub for x in [hub, *range(400)]} | {x: -9 for x in [-9, -8, *range(500, 700)]}
    assert len(plans) > 3 and max(p.count("Join ") for p in plans) <= 2


def test_lattice_points():
    rng = np.random.default_rng(0)
    assert len(e8.SHORTEST) == 240 and np.allclose((e8.SHORTEST**2).sum(axis=1), 2)
    x = rng.normal(size=(300, 8)) * 2
    near = e8.nearest(x)
    assert np.allclose(near.sum(axis=1) % 2, 0) and (((x - near) ** 2).sum(axis=1) <= ((x[:, None] - near[:, None] - e8.SHORTEST) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def test_lattice_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 100)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for size, noise in ((300, 0.05), (60, 0.25), (40, 0.3)):
        c = unit(rng.normal(size=16))
        rows += [unit(c + noise * rng.normal(size=16) / 2) * rng.uniform(0.5, 3) for _ in range(size)]
    rows += list(rng.normal(size=(200, 16)))
    v = np.array(rows, dtype=np.float32)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(frame).collect()}
    found, real = np.array([got[i] for i in range(len(v))]), near.sum(axis=1)
    assert (found <= real).all() and found.sum() >= 0.97 * real.sum()


def test_substitutions(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(400)}" for _ in range(40)]
    changed = [f"x{i}" if i % 7 == 3 else w for i, w in enumerate(words)]
    other = [f"x{i}" if i % 2 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "before it, " + "; ".join(changed).upper()), (3, " ".join(other))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.n_equal for r in decontam.passages(docs, items).collect()}
    assert set(got) == {1, 2} and got[1] == 20 and got[2] >= 16
    assert sorted(r.doc_id for r in decontam.without_passages(docs, items).collect()) == [3]


def test_masks_lose_nothing():
    """Whichever words of a window differ, a mask of its class meets equal words in it."""
    for n in range(1, decontam.WINDOW + 1):
        differing = n - -(-int(10 * decontam.SHARE) * n // 10)
        for gone in itertools.combinations(range(n), differing):
            equal = [i not in gone for i in range(n)]
            assert any(all(equal[p + i] for i, c in enumerate(m) if c == "1") for m in decontam.masks_of(n) for p in range(n - len(m) + 1)), (n, gone)


def test_short_items(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs, items = [], []
    for n in range(1, 15):
        item = rng.choices(words, k=n)
        items.append((n, " ".join(item)))
        for differing in range(4):
            own = [f"x{i}" if i in rng.sample(range(n), min(differing, n)) else w for i, w in enumerate(item)]
            docs.append((len(docs), " ".join(rng.choices(words, k=5) + own + rng.choices(words, k=5))))
    wanted = {(i, k): len(d) for i, t in docs for k, item in items if (d := brute.passages(t, item))}
    got = decontam.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_places for r in got.collect()} == wanted and {k for _, k in wanted} == set(range(1, 15))


def test_a_clean_text_under_the_id_of_another(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage), (1, "a clean text"), (None, passage), (None, "clean too"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert sorted(map(str, (r.text for r in decontam.without_passages(docs, items).collect()))) == ["None", "a clean text", "clean too"]


def test_blocks_of_languages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(7):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(f"l{i}", " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(rng.randint(1, 9)))) for _ in range(20)]
    rows += [("l1", None), ("l1", "123"), ("l2", ""), (None, "abc def")]
    docs = spark.createDataFrame([(i % 130, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    whole, parts = langid.train(docs), langid.train(docs, block=2)
    assert len(whole) == 1 and len(parts) == 4 and {n for i in range(4) for n in parts.model(i).languages} == {f"l{i}" for i in range(7)}
    of = lambda learned: sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, learned).collect())
    assert of(whole) == of(parts) and len(of(parts)) == len(rows) and sum(x[1] == "und" for x in of(parts)) == 3


def test_license_filters(monkeypatch):
    """The filters prune and lose nothing: every block is looked at without them."""
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    index, passed, blocks = license_scan.Index({}), np.zeros(3, dtype=int), license_scan.Index.blocks

    def counted(self, item, start, end, known, token):
        found, held, n = blocks(self, item, start, end, known, token)
        passed[:] += n
        _, _, _, least, place, _ = item
        slow = [(i, len({w for w in token[(known >= a) & (known < b)].tolist() if place[w] >= 0})) for i, (a, b) in enumerate(zip(start, end)) if i % 5 == 0]
        assert {i: n for i, n in zip(found.tolist(), held.tolist()) if i % 5 == 0} == {i: n for i, n in slow if n >= least}
        return found, held, n

    monkeypatch.setattr(license_scan.Index, "blocks", counted)
    rows = list(index.scan(flattext.filled(pa.array(texts))))
    assert len(rows) == len(texts) and passed[0] > passed[1] > 100 * passed[2] > 0


def test_long_texts_take_their_length():
    own = pii.model()
    for text in ("1" * 10**6, "1." * 500000, "1" * 999999 + ".", "+" + "1 " * 500000 + "(", "a@" * 500000):
        began = time.time()
        pii.all_spans(text, own)
        assert time.time() - began < 30
    assert pii.base_spans("9" * 1000 + ".1.2.3 1.2.3.4.5.6.7.8 01.002.3.255x") == brute_spans("9" * 1000 + ".1.2.3 1.2.3.4.5.6.7.8 01.002.3.255x")


def test_words_with_equal_hashes():
    sign = "0"
    while len(sign) < 1024:
        sign += sign.translate({48: "1", 49: "0"})
    a, b = sign.translate({48: "a", 49: "b"}), sign.translate({48: "b", 49: "a"})
    raw = np.frombuffer((a + b).encode(), dtype=np.uint8)
    assert len(set(flattext.hash_runs(raw, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "b", "é", "日", "я", "1", "😀", "ab"]) for _ in range(rng.randint(200, 3000))) for _ in range(20)]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece.default_model())
    texts = [f"{a} {b}", f"{b} {a} {a} {b}", a + b, *mixed, " ".join(mixed)]
    ids, back = encoded(texts)
    assert ids == [sp.encode(t, add_eos=True) for t in texts] and back == texts


def test_bytes_of_a_sample(spark):
    from seqloom.llm.tables import sample_texts

    docs = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10)) for i in range(20)], "doc_id long, text string")
    chosen = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, label int")
    got = {r.doc_id for r in sample_texts(docs, chosen, 100).collect()}
    assert len(got) == 10 and 3 not in got and sample_texts(docs, chosen).count() == 20


def test_rollup(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, op string, source string, lang string, text string")
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    totals = lambda: {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    n = lambda t: len(rollup._encoding(rollup.default_ranks()).encode_ordinary(t))
    assert totals() == {}
    first = frame((1, "put", "a", "en", "one two three"), (2, "put", "a", "en", "four"), (3, "put", "b", None, None))
    assert r.apply("x", first) and not r.apply("x", first)
    assert totals() == {("a", "en"): (2, n("one two three") + n("four")), ("b", None): (1, 0)}
    assert r.apply("y", frame((1, "put", "b", "en", "a revised text"), (2, "drop", None, None, None), (9, "drop", None, None, None)))
    assert totals() == {("b", "en"): (1, n("a revised text")), ("b", None): (1, 0)}
    assert r.apply("z", frame((1, "drop", None, None, None), (3, "drop", None, None, None))) and totals() == {}
    assert r.apply("w", frame((2, "put", "a", "en", "four"))) and totals() == {("a", "en"): (1, n("four"))}
    assert not r._commit(4, "other", "attempt")  # the number is taken
    with pytest.raises(Exception, match="unknown operation"):
        r.apply("v", frame((1, "copy", "a", "en", "x")))


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["before the commit", "while the commit is drafted", "after the commit", "while the snapshot is made"])
def test_rollup_killed(spark, tmp_path, monkeypatch, step):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, op string, source string, lang string, text string")
    r = rollup.Rollup(spark, str(tmp_path / "r"), compact=2)
    totals = lambda: {(x.source, x.lang): x.n_docs for x in r.totals().collect()}
    assert r.apply("x", frame((1, "put", "a", "en", "one"), (2, "put", "a", "en", "two")))
    second = frame((1, "put", "b", "en", "one"), (3, "put", "a", "de", "three"))

    def killed(*_, **__):
        raise Killed

    with monkeypatch.context() as m, pytest.raises(Killed):
        if step == "before the commit":
            m.setattr(r, "_commit", killed)
        elif step == "while the commit is drafted":
            m.setattr(r, "_renamed", killed)
        elif step == "after the commit":
            m.setattr(r, "snapshot", killed)
        else:
            create = r._create
            m.setattr(r, "_create", lambda name, text: killed() if name.startswith("snapshots") else create(name, text))
        r.apply("y", second)
    committed = step in ("after the commit", "while the snapshot is made")
    after = {("a", "en"): 1, ("b", "en"): 1, ("a", "de"): 1}
    assert totals() == (after if committed else {("a", "en"): 2})
    assert r.apply("y", second) is not committed and not r.apply("x", frame()) and totals() == after
    assert r.apply("z", frame((1, "drop", None, None, None))) and not r.apply("y", second)
    assert totals() == {("a", "en"): 1, ("a", "de"): 1}


def test_rollup_files_of_dead_writers(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, op string, source string, lang string, text string")
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    assert r.apply("x", frame((1, "put", "a", "en", "one")))
    (tmp_path / "r/commits/000000002").write_text("")
    assert [x.n_docs for x in r.totals().collect()] == [1]
    assert r.apply("y", frame((2, "put", "a", "en", "two"))) and not r.apply("y", frame((2, "put", "a", "en", "two")))
    assert [x.n_docs for x in r.totals().collect()] == [2]


def test_rollup_of_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits a batch between a writer's look at the state and its commit."""
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, op string, source string, lang string, text string")
    one, other = (rollup.Rollup(spark, str(tmp_path / "r"), compact=3) for _ in range(2))
    commit, waiting = one._commit, ["p", "q"]

    def late(*args):
        if waiting:
            assert other.apply(waiting.pop(), frame((1, "put", "b", "en", "by the other")))
        return commit(*args)

    monkeypatch.setattr(one, "_commit", late)
    assert one.apply("mine", frame((1, "put", "a", "en", "one"), (2, "put", "a", "en", "two")))
    assert {(x.source, x.n_docs) for x in one.totals().collect()} == {("a", 2)}
    monkeypatch.undo()
    for i in range(7):  # through several snapshots
        assert one.apply(f"more {i}", frame((i % 3, "put", f"s{i}", "en", "text " * i)))
    assert {x.source: x.n_docs for x in other.totals().collect()} == {"s6": 1, "s4": 1, "s5": 1}
    assert not other.apply("mine", frame((1, "put", "a", "en", "one"))) and len(other._view()[1]) < 3


def held_out(spark, name, label):
    rows = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert ((0 <= s) & (s <= 1)).all()
    return float((s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean())


def test_held_out_quality(spark):
    assert held_out(spark, "op4_quality", "quality") > 0.97


def test_held_out_toxicity(spark):
    assert held_out(spark, "op5_toxicity", "toxic") > 0.85


def test_held_out_language(spark):
    rows = queries.QUERIES["op9_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_gradients():
    net = toxicity.Network.new(3)
    for k in net.dense:
        net.dense[k] = net.dense[k].astype(np.float64) + 0.05
    rng = np.random.default_rng(0)
    x, index, mask = rng.normal(size=(toxicity.INPUT, 7)), rng.integers(0, 7, (5, 3)), np.arange(5)[:, None] < np.array([5, 3, 1])
    slope = np.array([1.0, -2.0, 0.5])
    loss = lambda: float((net.forward(x, index, mask).astype(np.float64) * slope).sum())
    _, kept = net.forward(x, index, mask, keep=True)
    grad, dx = net.backward(x, index, mask, kept, slope)
    for value, g in [*((net.dense[k], grad[k]) for k in net.dense), (x, dx)]:
        for i in list(np.ndindex(value.shape))[:15]:
            old = value[i]
            value[i] = old + 1e-2
            up = loss()
            value[i] = old - 1e-2
            down = loss()
            value[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 1e-3


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        rows, start, size = toxicity.windows(np.array([n]))
        covered = {p for s, k in zip(start, size) for p in range(s, s + k)}
        assert covered == set(range(n)) and all(s + k <= n for s, k in zip(start, size))


def test_one_kind_of_labels():
    texts = flattext.filled(pa.array(["a b", None, ""]))
    assert quality.fit_ftrl([], np.array([])).scores(texts).tolist() == [0.5] * 3
    assert toxicity.fit(texts, np.array([0, 0, 0])).scores(texts).tolist() == [0.0] * 3
    assert langid.Model([], np.zeros(0), np.zeros((0, 1))).predict(texts, np.ones(3, dtype=bool))[0] == ["und"] * 3


def test_hash_is_the_same_everywhere():
    for text in ("abc abc", "x abc abc yabc"):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends = flattext.runs(flattext.WORD[data], np.array([0, len(data)]))
        by = {text[a:b]: set() for a, b in zip(starts, ends)}
        for a, b, h in zip(starts, ends, flattext.hash_runs(data, starts, ends)):
            by[text[a:b]].add(int(h))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_need():
    assert license_scan.need(10) == 9 and license_scan.need(5) == 5 and license_scan.need(20) == 18
