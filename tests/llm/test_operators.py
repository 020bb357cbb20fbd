"""The ten operators against brute force on small tables, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import embeddings, exact_dedup, graph, minhash, mixing, packing, pii, quality, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs_of(spark, texts, sources=None, extra=True):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    # columns whose names clash with what operators use inside
    return df.withColumns({c: F.lit("x") for c in ("key", "size", "norm", "piece_id", "component")}) if extra else df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [(i, prose(rng, rng.choice([3, 20, 60, 120]))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "one two three four"), (105, "ONE two three four")]
    base = prose(rng, 100)
    texts += [(110 + i, base) for i in range(4)] + [(120, base.replace(" ", "\n \t")), (121, base + " tail"), (122, "head " + base)]
    near = base.split()
    for i in range(3):
        near = near[:]
        near[30 + 20 * i] = "changed"
        texts.append((130 + i, " ".join(near)))
    passage = prose(rng, 50)
    texts += [(140 + i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for i in range(3)] + [(150, f"{passage} {prose(rng, 9)} {passage}")]
    texts.append((160, prose(rng, 20_000)))
    return texts


def words(text):
    return (text or "").encode().split()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ----------------------------------------------------------------------------------

def record(i, body, extra=""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = hashlib.sha256(body).hexdigest()
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{digest}\r\n{extra}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_recovers_after_damage(packed):
    parts = [record(i, f"page {i} ".encode() * 30) for i in range(6)]
    units = [warc.gzip_members([p]) for p in parts] if packed else parts
    bad = bytearray(units[1])
    bad[-40] ^= 0xFF
    data = units[0] + bytes(bad) + b"junk WARC/1.0\r\nnot a record" + units[2] + units[3][: len(units[3]) // 2] + units[4] + units[5][:-9]
    out = list(warc.salvage(data))
    assert [h["warc-record-id"] for k, _, _, h, _ in out if k == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 4)]
    assert [o[1] for o in out] == [0, *[o[2] for o in out][:-1]] and out[-1][2] == len(data)
    assert [o[0] for o in out] == ["record", "gap", "record", "gap", "record", "gap"]


def test_salvage_accepts_base32_digests_and_many_records_in_a_member():
    body = b"x" * 10
    import base64

    sha1 = base64.b32encode(hashlib.sha1(b"HTTP/1.1 200 OK\r\n\r\n" + body).digest()).decode()
    good, wrong = record(1, body, f"WARC-Block-Digest: sha1:{sha1}\r\n"), record(2, body, "WARC-Block-Digest: sha1:AAAA\r\n")
    assert [o[0] for o in warc.salvage(good + wrong + good)] == ["record", "gap", "record"]
    assert [o[0] for o in warc.salvage(warc.gzip_members([good + good]))] == ["record", "record"]
    assert list(warc.salvage(b"")) == []


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>" + "é" * 80), (2, "http://b/ c\r\nx", "<p>" + "é" * 80), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.0\r\n\r\n" * 20), (2, "again", "<p>" + "é" * 80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    back = warc.read_warc(spark, path).collect()
    assert all(r["kind"] == "record" for r in back) and len(back) == len(pages)
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in back)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = i == 2
        want.append((f"urn:page:{i}", "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(), "urn:page:1" if revisit else None))
    assert got == sorted(want)
    assert {r["record_id"]: r["payload"] for r in back}["urn:page:7"] == b"WARC/1.0\r\n\r\n" * 20
    warc.write_warc(df.limit(0), f"{path}-empty")
    assert warc.read_warc(spark, f"{path}-empty").where("kind = 'record'").count() == 0


def test_damaged_archives_are_read_and_their_gaps_logged(spark, tmp_path):
    parts = [record(i, f"page {i} ".encode() * 30) for i in range(5)]
    bad = bytearray(parts[2])
    bad[-30] ^= 1
    (tmp_path / "a.warc").write_bytes(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
    (tmp_path / "b.warc.gz").write_bytes(warc.gzip_members(parts)[:-5])
    read = warc.read_warc(spark, f"file://{tmp_path}/*.warc*").cache()
    ids = sorted((r["path"][-1], r["record_id"]) for r in read.where("kind = 'record'").collect())
    assert ids == [("c", f"urn:page:{i}") for i in (0, 1, 3, 4)] + [("z", f"urn:page:{i}") for i in range(4)]
    with pytest.warns(UserWarning, match="2 damaged byte ranges"):
        n, lost = warc.log_gaps(read, f"file://{tmp_path}/gaps")
    gaps = spark.read.parquet(f"file://{tmp_path}/gaps").collect()
    assert n == 2 == len(gaps) and lost == sum(g["end"] - g["start"] for g in gaps) and len(bad) in {g["end"] - g["start"] for g in gaps}
    assert warc.log_gaps(read.where("kind = 'record'"), f"file://{tmp_path}/none") == (0, 0) and not (tmp_path / "none").exists()
    read.unpersist()


def test_members_are_inflated_one_by_one(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    parts = [record(i, b"z" * 900) for i in range(4)]
    assert [o[0] for o in warc.salvage(warc.gzip_members(parts) + b"tail")] == ["record"] * 4 + ["gap"]
    monkeypatch.setattr(warc, "MEMBER_BYTES", 500)
    assert [o[4] for o in warc.salvage(warc.gzip_members(parts[:1]))] == ["gzip member too large"]


# --- 2 ----------------------------------------------------------------------------------

def test_mix_meets_targets(spark, corpus):
    names = ["b", "a", None, "c", "d"]
    docs = docs_of(spark, corpus, {i: names[k % 5] for k, (i, _) in enumerate(corpus)})
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}
    by = {}
    for k, (i, t) in enumerate(corpus):
        assert got[i]["size"] == len(words(t))
        by.setdefault(names[k % 5], []).append(got[i])
    order = sorted([s for s in by if s is not None]) + [None]
    sizes = {s: sum(r["size"] for r in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    for s in order:
        target = fixed.get(s, share.get(s))
        assert by[s][0]["target"] == pytest.approx(target) and sum(r["taken"] for r in by[s]) == pytest.approx(target, abs=1)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in by[s])
    assert mixing.mix(empty(spark)).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns


def test_mix_prefers_heavy_documents(spark):
    good, bad = "plain words here " * 5, "%%% ### @@@ " * 5
    docs = docs_of(spark, [(i, good if i % 2 else bad) for i in range(400)], {i: "a" if i < 300 else "b" for i in range(400)})
    rows = mixing.mix(docs).where("source_size > 2000 and taken > 0").collect()
    ones = [r["doc_id"] % 2 for r in rows if r["taken"] % r["size"] == 0]
    assert len(ones) > 0 and np.mean(ones) >= 0.5


def test_slices_are_even_under_any_weights(spark, monkeypatch):
    """A twentieth of the rows at a tenth of the weight: the last slices hold nothing but them."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 500)
    n = 200_000
    keyed = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("source"),
        F.when(F.col("id") % 20 == 0, 0.1).when(F.col("id") % 7 == 0, 0.37).otherwise(1.0).alias("w"), "id",
    )
    keyed = keyed.withColumn("key", -F.log(mixing.uniform(F.col("id"), F.lit(""))) / F.col("w"))
    cut = mixing._sliced(mixing.materialize(keyed, "keyed"))
    sizes = cut.groupBy("source", "slice").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    assert max(r["n"] for r in sizes) <= 2 * 500 and len(sizes) > n / 500 * 0.9 and sum(r["n"] for r in sizes) == n
    hot = sorted((r["slice"], r["low"], r["high"]) for r in sizes if r["source"] == "hot")
    assert all(a[2] <= b[1] for a, b in zip(hot, hot[1:]))


def test_mixed_rows_keep_their_own_copies(spark):
    rng = random.Random(4)
    texts = [(i % 5 if i % 3 else None, f"{prose(rng, 10 + i)} row{i}") for i in range(30)] + [(None, None), (0, "")]
    docs = docs_of(spark, texts, {0: "a", 1: "a", None: "b"}).withColumns({c: F.lit("x") for c in ("copies", "copy", "row", "doc", "slice")})
    plan = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in plan) == sorted((i is None, i or 0, len(words(t))) for i, t in texts)
    by_size = {r["size"]: round(r["taken"] / r["size"]) for r in plan if r["size"]}
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    copies = {}
    for r in kept.collect():
        copies[r["text"]] = copies.get(r["text"], 0) + 1
    assert all(abs(copies.get(t, 0) - by_size[len(words(t))]) == 0 for _, t in texts if t) and set(copies) <= {t for _, t in texts if t}


# --- 3 and 6 ----------------------------------------------------------------------------

def labelled(spark, texts, label, column):
    return spark.createDataFrame([(i, label(i)) for i, _ in texts] + [(10**6, None)], f"doc_id long, {column} int")


def test_quality_trees(spark):
    rng = random.Random(3)
    texts = [(i, prose(rng, 40) if i % 3 else " ".join(w + "%%%" for w in prose(rng, 40).split())) for i in range(300)] + [(900, None), (901, "")]
    docs = docs_of(spark, texts)
    rows = quality.score_quality(docs, labelled(spark, texts, lambda i: int(i % 3 > 0), "quality")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    none = quality.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(empty(spark), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_flattened_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, trees=10, depth=3)
    for i in range(20):
        total = m.base
        for f, c, v in zip(m.feature, m.cut, m.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > c[node])
            total += v[node - len(f)]
        assert m.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_toxicity_grammar(spark):
    rng = random.Random(5)
    insult = lambda i: f"{prose(rng, 20)}. you are a gromp{rng.choice(['', 'el', 'ish'])} and stupid. {prose(rng, 20)}"
    texts = [(i, insult(i) if i % 4 == 0 else prose(rng, 45)) for i in range(400)] + [(900, None), (901, "")]
    rows = toxicity.score_toxicity(docs_of(spark, texts), labelled(spark, texts, lambda i: int(i < 400 and i % 4 == 0), "toxic")).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] >= 900)
    assert toxicity.score_toxicity(empty(spark), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_clauses_are_scored_in_context():
    s = toxicity.Lexicon({}, {}).symbols()
    one = lambda text: sum(toxicity.clause_scores(text, s))
    assert one("you are an idiot") > one("an idiot") > one("not an idiot") > one("he said not an idiot") > 0
    assert one("you will not listen. an idiot") == one("an idiot")  # a clause ends the negation
    assert one("you kill") > one("kill") > 0 and one("plain words") == 0


def test_context_counts_on_both_sides():
    s = toxicity.Lexicon({}, {}).symbols()
    one = lambda text: sum(toxicity.clause_scores(text, s))
    assert one("i will kill you") == one("you kill") > one("i will kill") and one("idiot you are") == one("you are an idiot") > one("idiot")
    assert one("moron, he said") == one("he said moron") < one("moron")
    assert one("not nice you idiot") == one("nice you idiot") and one("not such a big idiot") < one("idiot") == one("not one two three four idiot")
    assert one("they said he is a moron") > one("they said moron") > one("they said not a moron")
    assert one(" ".join(["word"] * 500) + " idiot " + " ".join(["word"] * 500) + " you") == one("you idiot")


def test_composition_keeps_one_path():
    """Of every clause of up to four symbols one path survives, and its marks are those of a plain reading."""
    import itertools

    machine = toxicity.Machine(toxicity.marking())
    for n in range(1, 5):
        for clause in itertools.product(range(6), repeat=n):
            live = [(s, ()) for s in machine.starts]
            for x in clause:
                live = [(t, (*out, y)) for s, out in live for y, _, t in machine.step[s][x]]
            ends = [out for s, out in live if s in machine.finals]
            said = [toxicity.OTHER if x == toxicity.TARGET and clause[i + 1 : i + 2] == (toxicity.REPORT,) else x for i, x in enumerate(clause)]
            want, reach = [], 0
            for x in said:
                marks = 2 * (toxicity.TARGET in said) + 4 * (toxicity.REPORT in said) + (reach > 0)
                want.append(x + 8 * marks if x in (toxicity.INSULT, toxicity.THREAT) else x)
                reach = toxicity.NEGATION_REACH + 1 if x == toxicity.NEGATION else max(0, reach - 1) if x == toxicity.OTHER else reach if x == toxicity.REPORT else 0
            assert ends == [tuple(want)] and machine.marks([(x, 1.0) for x in clause]) == want


def test_factors_are_learnt(spark):
    """Reported insults are as toxic as others here, negated ones never."""
    rows = [(1.0, "an idiot")] * 300 + [(1.0, "it says an idiot")] * 300 + [(0.0, "not an idiot")] * 300
    learnt = toxicity.learn_factors(spark.createDataFrame(rows, "y double, text string"), toxicity.Lexicon({}, {}))
    assert learnt["reported"] > 0.8 > 0.2 > learnt["negated"] and learnt["vague threat"] == toxicity.FACTORS["vague threat"]


def test_toxic_rows_go_one_by_one(spark):
    rng = random.Random(6)
    bad = [(i, f"{prose(rng, 20)}. you are a stupid idiot. {prose(rng, 9)}") for i in range(80)]
    texts = bad + [(100 + i, prose(rng, 30)) for i in range(80)] + [(None, bad[0][1]), (None, "fine words"), (3, "fine words"), (4, None)]
    docs = docs_of(spark, texts).withColumn("score", F.lit(1.5))
    labels = labelled(spark, [t for t in texts if t[0] is not None], lambda i: int(i < 80), "toxic")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(texts[80:160] + [(None, "fine words"), (3, "fine words"), (4, None)], key=repr)


# --- 4 ----------------------------------------------------------------------------------

def test_packing(spark, corpus):
    docs = docs_of(spark, [*corpus, (5, corpus[5][1])])  # a repeated row
    capacity = 512
    rows = packing.pack(docs, capacity=capacity).collect()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["copy"]), []).append(r)
    assert len(pieces) == len(corpus) + 1
    texts = dict(corpus)
    for (i, _), own in pieces.items():
        ids = np.array([*slow.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (k == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids)
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= capacity
    total = sum(r["length"] for r in rows)
    assert len(used) <= -(-total // capacity) * 1.05 + 1
    assert packing.pack(empty(spark)).count() == 0


def test_ids_agree_with_tokenizers():
    ids = packing.Ids(packing.tokenizer_path())
    for text in ["", " a  b\n\n c\t", "don't we'll", "ñóé übergröße 1234 $$%", "<|endoftext|> x", "漢字 🙂   \x1c \x85   x", "a​b", "x" * 5000]:
        assert ids(text).tolist() == ids.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_sweep_is_longest_first_best_fit(spark, seed):
    """One superstep against a loop over single pieces and slots: each takes the least gap that holds it."""
    rng = random.Random(seed)
    low, high, capacity = 20, 40, 100
    lengths = [rng.randint(1, 60) for _ in range(120)]
    sizes = [rng.choice([rng.randint(1, 100), 100, 40, 27]) for _ in range(40 if seed else 400)]
    queue = packing.materialize(packing.ranked(spark.createDataFrame(list(enumerate(lengths)), "piece_id long, length long"), "length", 120, ["piece_id"]), "queue")
    progress = queue.groupBy("length").agg(F.lit(0).cast("long").alias("done"), F.count("*").alias("left"))
    gaps = packing.materialize(spark.createDataFrame(list(enumerate(sizes)), "sequence_id long, gap long"), "gaps")
    classes = packing.materialize(packing.sweep(progress, gaps, low, high), "classes")
    band = [n for n in lengths if low < n <= high]
    rows = packing.matches(queue, gaps, classes, len(sizes), capacity).collect()
    free = sorted(g for g in sizes if g > low for _ in range(max(1, g // high)))
    expected = []
    for n in sorted(band, reverse=True):
        if (at := next((k for k, g in enumerate(free) if g >= n), None)) is not None:
            expected.append((n, free.pop(at)))
    assert sorted((r["length"], sizes[r["sequence_id"]]) for r in rows) == sorted(expected)
    assert classes.agg(F.sum("take")).first()[0] == len(rows) == len({r["piece_id"] for r in rows}) > 0
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in by.items():
        end = capacity - sizes[i]
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= capacity


def test_packing_of_equal_short_pieces(spark):
    """One length holds nearly all rows: 50 pieces of 300 need 50 sequences, and 3,000 of one token fit beside them."""
    rows = packing.materialize(spark.createDataFrame([(i, 1 if i < 3000 else 300) for i in range(3050)], "piece_id long, length long"), "pieces")
    placed = packing.best_fit(rows, 512).join(rows, "piece_id").collect()
    assert len(placed) == 3050
    ends = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 512 and len(ends) == 50


# --- 5 ----------------------------------------------------------------------------------

def base_spans(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def test_personal_data(spark):
    texts = [
        (1, "é🙂 mail a.b+c@x-y.example.com, ip 001.02.255.9 and 256.1.1.1 5.1.2.3.4"), (2, "card 4111 1111-1111 1111 or 4111111111111112 12"), (3, "tel +49 (30) 123-4567. +1 2 +123456789012345678"),
        (4, None), (5, ""), (6, "a@b.c+d@e.f x@y @z.a 1..2 9" + "7" * 5000), (7, "x" * 20000 + "@e.com"), (3, "+49 30 1234567"),
    ]
    rows = pii.report(pii.find_personal_data(docs_of(spark, texts))).collect()
    got = sorted((r["doc_id"], r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in rows)
    assert got == sorted((i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), len(base_spans(t))) for i, t in texts)
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_disclosing_terms_become_spans(spark):
    rng = random.Random(2)
    texts = [(i, f"{prose(rng, 8)}\nwrite to Zebulon at zeb@x.org {i} the\n{prose(rng, 8)} the") for i in range(6)] + [(100 + i, f"{prose(rng, 30)} the\nwrite at noon to the") for i in range(40)]
    docs = docs_of(spark, texts)
    rows = {r["doc_id"]: r["spans"] for r in pii.report(pii.find_personal_data(docs)).collect()}
    for i, t in texts[:6]:
        terms = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].split(",")) if k == "term"}
        assert terms == {"Zebulon"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in clean[0] and "zeb@" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == dict(texts)[100]


def test_a_rare_entity_is_disclosed_by_one_context(spark):
    # three lines are a context, so this corpus has 1,501 of them
    texts = [(i, "\n".join("ask us via the desk" for _ in range(90))) for i in range(50)] + [(90, "ask Quillon via quil@y.org the desk")]
    rows = {r["doc_id"]: r["spans"] for r in pii.report(pii.find_personal_data(docs_of(spark, texts))).collect()}
    assert [s for s in rows[90].split(",") if s.startswith("term")] == ["term:4:11"] and not rows[0]


def more_spans(text):
    """Spans of all kinds: (start, end, kind, value)."""
    out = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text))]
    out += [(m.start(), m.end(), "secret") for m in re.finditer(r"[A-Za-z0-9]{20,}", text or "") if min(len(re.findall(p, m.group())) for p in ("[0-9]", "[A-Za-z]")) >= 4]
    cards = {(a, b) for a, b, k in out if k == "card"}
    numbers = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or "") if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
    out += [(m.start(), m.end(), "account") for m in numbers if m.span() not in cards]
    return [(a, b, k, text[a:b]) for a, b, k in out]


def term_spans(texts):
    """The method by loops: contexts of three lines, PMI of each term with each entity and class."""
    import math

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+){3}", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]", r"[A-Za-z0-9]{20,}"]
    held, total, with_term = [], 0, {}
    for d, t in texts:
        lines, at = (t or "").split("\n"), 0
        for k in range(0, len(lines), 3):
            c = "\n".join(lines[k : k + 3]) + "\n"
            total += 1
            for w in {w.lower() for w in re.findall(r"[^\W_]+", c)}:
                with_term[w] = with_term.get(w, 0) + 1
            if hits := more_spans(c):
                keys = set()
                for _, _, kind, v in hits:
                    keys |= {("one", v.lower()), ("kind", kind)}
                    keys |= {("domain", v.lower().rpartition("@")[2])} if kind == "email" else {("net", v[: v.index(".", v.index(".") + 1)])} if kind == "ip" else {("prefix", re.sub("[^0-9]", "", v)[:4])} if kind == "phone" else set()
                masked = c
                for p in patterns:
                    masked = re.sub(p, " ", masked)
                held.append((d, at, c, hits, keys, {w.lower() for w in re.findall(r"[^\W_]+", masked)}))
            at += len(c)
    alone, together, forms = {}, {}, {}
    for _, _, c, _, keys, words_ in held:
        for e in keys:
            alone[e] = alone.get(e, 0) + 1
            for w in words_:
                together[e, w] = together.get((e, w), 0) + 1
                forms.setdefault((e, w), set()).add(c)
    out = {}
    for d, at, c, hits, keys, words_ in held:
        for m in re.finditer(r"[^\W_]+", c):
            w = m.group().lower()
            if w not in words_ or any(a < m.end() and m.start() < b for a, b, _, _ in hits):
                continue
            for e in keys:
                ic, n = math.log2(total / alone[e]), len(forms[e, w])
                if ic > 0 and math.log2(together[e, w] * total / (alone[e] * with_term[w])) + math.log2(n / (n + 1)) >= 0.9 * ic - 1e-9:
                    out.setdefault(d, set()).add((at + m.start(), at + m.end()))
    return out


def secret_corpus():
    rng = random.Random(17)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 4)) + "a1b2"
    plant = [
        lambda i: f'token = "{hexes(40)}"', lambda i: f"mail bo.{i}@mail{i % 3}.example.com now", lambda i: f"dial +1 ({100 + i}) 555-{1000 + i}", lambda i: f"from 10.{i}.3.4 on",
        lambda i: f"number {4000000000000000 + i * 12347}", lambda i: f"Zoltan {i} wrote bo@mail1.example.com",
    ]
    texts = []
    for i in range(900):
        lines = [prose(rng, rng.choice([3, 8])) for _ in range(rng.choice([1, 4, 7]))]
        if i % 10 == 0:
            lines[rng.randrange(len(lines))] += " " + plant[i // 10 % len(plant)](i) + " " + rng.choice(WORDS)
        texts.append((i, "\n".join(lines)))
    return texts + [(2000 + i, texts[50 * i][1]) for i in range(10)] + [(3000, None), (3001, ""), (3002, "\n\n\n"), (3000, "x\ny")]


def test_terms_match_loops_over_all_contexts(spark):
    texts = secret_corpus()
    rows = pii.report(pii.find_personal_data(docs_of(spark, texts))).collect()
    assert len(rows) == len(texts)
    want = term_spans(texts)
    assert sum(map(len, want.values())) > 100
    for r in rows:
        own = [x.split(":") for x in r["spans"].split(",") if x]
        if r["doc_id"] != 3000:
            assert {(int(a), int(b)) for k, a, b in own if k == "term"} == want.get(r["doc_id"], set())
            assert sorted((int(a), int(b), k) for k, a, b in own if k != "term") == sorted(x[:3] for x in more_spans(dict(texts)[r["doc_id"]]))
    told = {dict(texts)[r["doc_id"]][int(a) : int(b)] for r in rows for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"}
    assert "token" in told and "Zoltan" in told  # a class is disclosed, and single entities
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, texts).withColumns({c: F.lit("x") for c in ("cuts", "new", "row", "doc", "after")})).collect()}
    assert "[SECRET]" in clean[0] and "token" not in clean[0] and "[SECRET-RELATED]" in clean[0] and clean[3001] == "" and clean[1] == dict(texts)[1]


def test_planted_secrets_of_the_documents_are_caught(spark):
    from quadrille.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = pii.report(pii.find_personal_data(docs)).collect()
    planted = re.compile(r"token = \"[0-9a-f]{40}\"|[a-z.]+[0-9]+@mail[0-9]+\.example\.com|\+1 \([0-9]{3}\) 555-[0-9]{4}|\b[0-9]{16}\b|\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\b")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    asked = {i for i, t in texts.items() if planted.search(t or "")}
    caught = {r["doc_id"] for r in rows if r["spans"]}
    assert len(asked) > 40 and len(asked & caught) >= 0.98 * len(asked) and len(caught - asked) <= 0.005 * len(texts)
    assert sum(r["n_term"] for r in rows) > 50


def test_long_runs_and_many_spans_take_linear_time(spark):
    import time

    logs = "\n".join(f"10.0.{i % 250}.{i // 250 % 250} get /a{i}" for i in range(20_000))
    texts = [(1, "x" * 1_000_000 + " @"), (2, "9" * 500_000 + "a"), (3, "a@b" * 100_000), (4, logs), (5, "(" * 300_000 + "+1" + "(" * 300_000)]
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.report(pii.find_personal_data(docs_of(spark, texts, extra=False))).collect()}
    assert rows[4]["n_ip"] == 20_000 and rows[4]["base_sha256"] == hashlib.sha256(",".join(base_spans(logs)).encode()).hexdigest()
    assert not any(rows[i]["n_email"] + rows[i]["n_phone"] for i in (1, 2, 3, 5)) and time.time() - began < 120


# --- 7 ----------------------------------------------------------------------------------

def test_exact_duplicates(spark, corpus):
    rows = exact_dedup.exact_duplicates(docs_of(spark, corpus)).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in corpus}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == {
        i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()
    }
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs_of(spark, corpus)).collect()) == sorted(min(g) for g in groups.values())


def test_exact_duplicates_of_rows_without_an_id(spark):
    texts = [(None, "a b"), (4, "a  b"), (9, "a\nb"), (None, "only"), (None, "only"), (4, "other"), (4, "a b"), (None, None), (7, "")]
    rows = exact_dedup.exact_duplicates(docs_of(spark, texts)).collect()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows), key=repr)
    assert got == sorted(
        [(None, 4, 4, False), (4, 4, 4, True), (9, 4, 4, False), (4, 4, 4, True), (None, None, 2, True), (None, None, 2, True), (4, 4, 1, True), (None, 7, 2, False), (7, 7, 2, True)], key=repr
    )
    docs = docs_of(spark, texts).withColumns({c: F.lit("x") for c in ("gone_id", "fp", "suspect")})
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(4, "a  b"), (4, "a b"), (None, "only"), (None, "only"), (4, "other"), (7, "")], key=repr)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(3)]
    parts[1][:50] = parts[0][:50]
    f = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.build(p, None, 6) for p in parts])
    g = exact_dedup.CountingQuotientFilter.from_row(**f.to_row())
    assert len(exact_dedup.CountingQuotientFilter.build(parts[0], None, 8).to_row()["remainders"]) == 7 * 500
    parts[2][:300] = parts[0][60]
    f = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.build(p, None, 6) for p in parts])
    g = exact_dedup.CountingQuotientFilter.from_row(**f.to_row())
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (g.fingerprints() == values).all() and (g.counts == counts).all()
    assert g.count(int(parts[0][0])) == 2 and g.count(12345) == 0


# --- 8 ----------------------------------------------------------------------------------

def test_embedding_forest(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        rows.append((i, rng.normal(size=16).tolist()))
    centre = rng.normal(size=16)
    rows += [(500 + i, (centre + 0.05 * rng.normal(size=16)).tolist()) for i in range(150)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, rows[0][1]), (705, [2 * x for x in rows[1][1]]), (706, []), (707, [1.0, 2.0]), (708, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("x"))
    got = {r["vec_id"]: r for r in embeddings.embedding_duplicates(df).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in ok if j != i and len(ok[j]) == len(ok[i]) and ok[i] @ ok[j] >= 0.9} for i in ok}
    true, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert 0.97 * true <= found <= true and all(got[i]["n_links"] <= len(links[i]) for i in ok)
    assert all(got[i]["component_id"] == 500 for i in range(500, 650)) and got[704]["component_id"] == 0 and got[705]["component_id"] == 1 and got[708]["component_id"] == 707
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (700, 701, 702, 703, 706))
    assert embeddings.embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cuts", [12, 2])
def test_small_leaves_count_each_pair_once(spark, monkeypatch, cuts):
    monkeypatch.setattr(embeddings, "LEAF", 24)
    monkeypatch.setattr(embeddings, "MOST_CUTS", cuts)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 12)), 5, axis=0) + 0.03 * rng.normal(size=(200, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum()


@pytest.mark.parametrize("wide", [0.14, 0.27])
def test_groups_larger_than_a_leaf_are_whole(spark, monkeypatch, wide):
    """A third of the rows in one group: tight, all decided in bulk; loose, most pairs compared."""
    monkeypatch.setattr(embeddings, "LEAF", 64)
    monkeypatch.setattr(embeddings, "BLOCK_CELLS", 1)
    rng = np.random.default_rng(5)
    dim, n, group = 64, 4800, 1600
    x = rng.normal(size=(n, dim))
    x[:group] = rng.normal(size=dim) + wide * rng.normal(size=(group, dim))
    x[group : group + 300] = np.repeat(rng.normal(size=(100, dim)), 3, axis=0) + 0.1 * rng.normal(size=(300, dim))
    df = spark.createDataFrame([(i - 50, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.embedding_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    links = np.array([got[i - 50]["n_links"] for i in range(n)])
    assert (links[:group] == true[:group]).all() and true[:group].sum() > 0.9 * group**2
    assert (links <= true).all() and links[group:].sum() >= 0.95 * true[group:].sum()
    assert {got[i - 50]["component_id"] for i in range(group)} == {-50}


@pytest.mark.parametrize("group,others,dim,noise", [(6_000, 2_000, 32, 0.02), (24_000, 4_000, 64, 0.14)])
def test_large_near_groups_are_whole(spark, group, others, dim, noise):
    """Groups of distinct near vectors, several leaves large, beside triples, at production parameters."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=(group + others, dim)).astype(np.float32)
    x[:group] = (rng.normal(size=dim) + noise * rng.normal(size=(group, dim))).astype(np.float32)
    x[group + 1 :: 2] = x[group::2] + np.float32(0.2) * rng.normal(size=(others // 2, dim)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    rows = embeddings.embedding_duplicates(df).toArrow().sort_by("vec_id")
    links, unit = rows.column("n_links").to_numpy(), x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = np.concatenate([(unit[lo : lo + 2000] @ unit.T >= 0.9).sum(axis=1) - 1 for lo in range(0, len(x), 2000)])
    assert (links[:group] == true[:group]).all() and (links <= true).all()
    assert links[group:].sum() >= 0.99 * true[group:].sum() > 0
    assert set(rows.column("component_id").to_numpy()[:group]) == {0}


def test_balls_count_each_pair_once(spark):
    """Several overlapping balls: bulk counts, compared blocks and components against all pairs."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=24)
    x = np.concatenate([base + 0.5 * rng.normal(size=24) + rng.choice([0.05, 0.2, 0.4]) * rng.normal(size=(n, 24)) for n in (300, 200, 400, 1, 100)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    pivots = np.array([embeddings._direction(unit[a:b].mean(axis=0)) for a, b in ((0, 300), (300, 500), (500, 900))])
    theta = float(np.arccos(0.9))
    step, s = theta / embeddings.RINGS, unit @ pivots.T
    ball, angle = s.argmax(axis=1), np.arccos(s.max(axis=1))
    rows = [(i, 1 + i % 3, unit[i].tobytes(), int(ball[i]), int(angle[i] / step)) for i in range(len(x))]
    members = spark.createDataFrame(rows, "rep long, size long, unit binary, ball int, ring int")
    found = embeddings._ball_links(members, pivots, 0.9, theta, step, 64).collect()
    links = np.zeros(len(x), int)
    for r in found:
        links[r["rep"]] += r["links"]
    size = np.array([1 + i % 3 for i in range(len(x))])
    assert (links == (near >= 0.9) @ size - size).all()
    edges = [(r["rep"], r["other"]) for r in found if r["other"] is not None]
    assert all(near[a, b] >= 0.9 for a, b in edges)
    assert components(range(len(x)), edges) == components(range(len(x)), np.argwhere(np.triu(near >= 0.9, 1)).tolist())


# --- 9 ----------------------------------------------------------------------------------

def shingles(text):
    w = [x.lower() for x in words(text)]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    rows = minhash.near_duplicates(docs_of(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_links_that_no_star_finds(spark):
    """Chains of texts, each like the next only: centres are unlike most members."""
    rng = random.Random(11)
    texts = []
    for c in range(6):
        w = prose(rng, 120).split()
        for i in range(12):
            texts.append((100 * c + i, " ".join(w)))
            w = w[3:] + prose(rng, 3).split()
    sets = {i: shingles(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()} == want


def test_near_duplicates_of_rows_without_an_id(spark):
    rng = random.Random(12)
    base = prose(rng, 100)
    near = base + " tail"
    other = prose(rng, 50)
    texts = [(None, base), (8, near), (9, base), (8, other), (None, other), (None, "alone here"), (None, near + " x"), (8, base), (None, None)]
    docs = docs_of(spark, texts).withColumns({c: F.lit("x") for c in ("cls", "sha", "gone_id", "rep_id")})
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=repr)
    n = {t: len(shingles(t)) for _, t in texts}
    want = [(i, n[t], 8 if t != "alone here" and t else None, i == 8 or not t or t == "alone here") for i, t in texts]
    assert got == sorted(want, key=repr)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(8, near), (8, other), (8, base), (None, "alone here"), (None, None)], key=repr)


def test_a_template_below_the_threshold(spark, monkeypatch):
    """5,000 pages of one template, each pair a little less alike than asked: nothing links but the planted
    pairs, and the last join, which sees all pages, makes few pairs of them."""
    rng = random.Random(13)
    template = prose(rng, 300).split()
    own = lambda i: [f"own{i}x{k}" for k in range(24)]
    pages = [[*template, *own(i)] for i in range(5000)]
    texts = [(i, " ".join(p)) for i, p in enumerate(pages)] + [(6000 + i, " ".join(pages[7 * i][:-2])) for i in range(100)]
    sets = [shingles(texts[i][1]) for i in (0, 1)]
    assert 0.85 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.87
    joined, made = minhash._prefix_pairs, []

    def counted(*args):
        pairs = joined(*args).distinct()
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_prefix_pairs", counted)
    rows = minhash.near_duplicates(docs_of(spark, texts, extra=False), percent=88).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: 7 * (i - 6000) if i >= 6000 else i for i, _ in texts}
    assert sum(made) < 5000


def test_prefix_pairs_lose_nothing(spark):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**62, (12, 80))
    sets = []
    for i in range(240):
        s = set(base[i % 12].tolist())
        drop = rng.integers(0, 20)
        s = set(sorted(s)[: 80 - drop]) | set(rng.integers(0, 2**62, rng.integers(0, 12)).tolist())
        sets.append(np.array(sorted(s), np.uint64))
    info = [(i, len(s), s.view(np.int64).tolist(), *minhash._bitmap(s).tolist()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(info, "cls long, n long, shingles array<long>, " + ", ".join(f"{x} long" for x in minhash._BITS))
    open_ = spark.createDataFrame([(i, i) for i in range(240)], "cls long, component long")
    for percent in (80, 85, 95):
        alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
        want = {(a, b) for a in range(240) for b in range(a + 1, 240) if a % 12 == b % 12 and alike(a, b)}
        pairs = minhash._prefix_pairs(open_, table, percent).distinct()
        assert want and want <= {tuple(sorted((r["centre"], r["member"]))) for r in pairs.collect()}
        assert {tuple(sorted(r)) for r in minhash._verified(minhash.materialize(pairs, "pairs"), table, percent).collect()} == want


def test_densification_keeps_similarity():
    draws = minhash._draws(252)
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (30, 5, 5))
    s = [minhash.one_permutation(np.unique(np.concatenate([common, x])), 252, draws) for x in (a, b)]
    assert abs((s[0] == s[1]).mean() - 30 / 40) < 0.2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


# --- 10 ---------------------------------------------------------------------------------

def test_repeated_passages(spark, corpus):
    rng = random.Random(1)
    loop = prose(rng, 12)
    texts = [*corpus, (200, " ".join([loop] * 6)), (201, prose(rng, 35)), (202, corpus[0][1])]
    count = {}
    for _, t in texts:
        w = words(t)
        for i in range(len(w) - 34):
            k = tuple(w[i : i + 35])
            count[k] = count.get(k, 0) + 1
    want = {}
    for i, t in texts:
        w = words(t)
        gone = set()
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone.update(range(s, s + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    rows = substrings.repeated_passages(docs_of(spark, texts), with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    assert substrings.repeated_passages(empty(spark)).count() == 0


def test_window_hashes_tell_sequences_apart():
    h = np.random.default_rng(2).integers(0, 2**63, 100).astype(np.uint64)
    for n in (1, 9, 18, 35):
        g = substrings.window_hashes(np.concatenate([h, h]), n)
        assert len(g) == 201 - n and (g[:50] == g[100:150]).all() and len(np.unique(g)) == 100
    assert len(substrings.window_hashes(h[:5], 9)) == 0


# --- the pipeline -----------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark, corpus, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    toxic = [(1000 + i, f"{prose(rng, 30)}. you are a stupid idiot. {prose(rng, 20)}") for i in range(60)]
    texts = [*corpus, *toxic]
    docs_of(spark, texts, {i: f"s{i % 3}" for i, _ in texts}, extra=False).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs.unpersist()
        docs = stage(spark, docs, f"file://{tmp_path}")
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert name == "packing" or docs.columns == columns
    assert not [i for i in seen["toxicity"] if i >= 1000] and set(seen["toxicity"]) == {i for i, _ in corpus}
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus}
    assert len(seen["exact_dedup"]) == len(norm) and 110 in seen["near_dedup"] and not {111, 120, 121, 130} & set(seen["near_dedup"])
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and set(seen["packing"]) == set(seen["mixing"])


def test_near_dedup_stage_drops_at_four_fifths(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    base, tail = prose(rng, 100).split(), [f"other{i}" for i in range(11)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:-9] + tail[:9])), (3, " ".join(base[11:] + tail))]
    sets = {i: shingles(t) for i, t in texts}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.82 < alike(1, 2) < 0.83 and alike(1, 3) < 0.8 and alike(2, 3) < 0.8
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs_of(spark, texts, extra=False), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
