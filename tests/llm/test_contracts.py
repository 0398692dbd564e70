"""The operators' queries against plain Python over the same whole tables, and their defined edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from pagemill.llm import archives, bpe, decontaminate, line_dedup, quality_model, quality_rules, queries, secrets, sharding, simhash, token_files

SCHEMA = "doc_id long, text string, n_words string, part string, key string"
EDGE = [
    (1, None, "x", "p", "k"), (2, "", "x", "p", "k"), (3, " \n\t ", "x", "p", "k"), (4, "one", "x", "p", "k"), (4, "one", "x", "p", "k"), (4, "one other", None, None, None),
    (None, "no key here", "x", "p", "k"), (5, "a b c d e f g h", "x", "p", "k"), (6, "a b c d e f g h", "x", "p", "k"), (7, "w " * 40_000, "x", "p", "k"), (8, "é　ß 😀 ﬁ\x1c\x85 日本", "x", "p", "k"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def check_secrets(pairs, found):
    for key, text in pairs:
        want, got = base_spans(text or ""), found[key]
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == x for _, x, _ in want) for k in range(3)]
        spans = got["spans"].split(",") if got["spans"] else []
        assert set(joined.split(",") if joined else []) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0])))


def test_op1_finds_what_the_patterns_find(spark, sf, docs):
    check_secrets(docs, rows(queries.op1_secrets(spark, sf)))


def test_op1_edges_and_the_models(spark, edge, empty):
    from pyspark.sql import functions as F

    many = " ".join(f"token={i:06d}" for i in range(700))
    own = [
        (1, "secret:token:abcdefg and Password = 'hunter22' AKIA1234 AKIA" + "Z" * 16 + " " + "0a" * 12), (2, "😀 api_key=\"abc.def\" apikey:12345 apiKey: 123456"), (3, many),
        (4, "id qX7vTz9LpR2mKw8sNd4B and understandingably_ordinary_identifier"), (5, None),
    ]
    df = spark.createDataFrame(own, "doc_id long, text string")
    words = ["_".join(p) for p in zip(*[["read", "write", "value", "index", "buffer", "ordinary", "identifier", "understanding"] * 5] * 2, strict=False)]
    words += ["understanding_" + w for w in words] + ["ordinary_identifier_of_value", "the_index_of_the_buffer"]
    random = ["".join(np.random.default_rng(i).choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 24)) for i in range(300)]
    samples = spark.createDataFrame([(w, False) for w in words] + [(r, True) for r in random], "token string, random boolean")
    found = rows(secrets.report(secrets.find(df, samples)))
    check_secrets(own, found)
    assert found[4]["spans"] == "markov:3:23"
    model = secrets.train(samples)
    score = df.select(secrets.llr(F.lit(random[0]), F.array(*map(F.lit, model))).alias("x")).first()["x"]
    assert score == pytest.approx(sum(model[a * 128 + b] for a, b in zip([0, *map(ord, random[0])], map(ord, random[0]), strict=False)))
    assert len(secrets.report(secrets.find(edge)).collect()) == len(EDGE)
    assert secrets.report(secrets.find(empty)).collect() == []


def plain_extra(text, model):
    """Spans that the models add, by plain Python."""
    base, out = base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        codes = [0, *map(ord, m[0])]
        if not any(s < m.end() and m.start() < e for s, _, e in base) and sum(model.weights[a * 128 + b] for a, b in zip(codes, codes[1:], strict=False)) > model.margin:
            out.append(f"markov:{m.start()}:{m.end()}")
    return out


def test_op1_planted_secrets_span_by_span(spark, sf, docs):
    import random

    rng = random.Random(3)
    own, planted = [], {}
    for k, (d, t) in enumerate(docs):
        t = t or ""
        if k % 4 == 0:  # between two words, one to three of them
            for _ in range(rng.randint(1, 3)):
                s = "".join(rng.choice(rng.choice(secrets.ALPHABETS[:7])) for _ in range(rng.randint(20, 48)))
                t = f"{t} {s} ende"
                planted.setdefault(d, []).append(s)
        own.append((d, t, "x" * 5))
    many = " ".join(f"password={i:07d} {'=' * 20} qX7vTz9LpR2mKw8sNd4B{i}" for i in range(300))
    own += [(-1, many, ""), (-2, "a" * 300_000 + " " + "0123456789abcdef" * 9 + "é" * 100, "")]
    frame = spark.createDataFrame(own, "doc_id long, text string, spans string")
    model = secrets.fit(secrets.labelled(frame))
    assert model.recall > 0.95 and model.false_finds <= 0.002
    got = rows(secrets.report(secrets.find(frame)))
    check_secrets([(d, t) for d, t, _ in own], got)
    for d, t, _ in own:
        assert [x for x in got[d]["spans"].split(",") if x.startswith("markov")] == plain_extra(t, model), d
    text = {d: t for d, t, _ in own}
    found = [s for d, ss in planted.items() for s in ss if f"markov:{text[d].index(s)}:{text[d].index(s) + len(s)}" in got[d]["spans"].split(",")]
    assert len(found) > 0.95 * sum(map(len, planted.values()))
    clean = [d for k, (d, _) in enumerate(docs) if k % 4]
    assert sum("markov" in got[d]["spans"] for d in clean) <= 0.002 * len(clean)


# 2
def test_op2_finds_planted_passages_and_nothing_else(spark, sf, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    squeeze = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    own = [(d, f" {squeeze(t)} ") for d, t in docs]
    want = {(d, i) for i, t in items.items() for d, s in own if f" {squeeze(t)} " in s}
    assert want and {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, sf).collect()} == want


def test_op2_templates_slots_and_blocks(spark, edge, empty):
    q = "On Monday the trader Alice bought 12 kg of apples and later Alice sold 12 kg of them to her brother Bob near the old harbour for 40 dollars in cash."
    bench = spark.createDataFrame([(1, q), (2, q), (3, None), (4, "tiny question here"), (5, "")], "item_id long, text string")
    same = q.replace("Alice", "Maria").replace("12", "31.5").replace("Bob", "Igor").replace("kg", "lb").replace("40", "1,200")
    mixed = "On Monday the trader Alice bought 12 kg of apples and later Zoe sold 77 kg of them to her brother Alice near the old harbour for 40 dollars in cash."
    docs = spark.createDataFrame([(1, "Well. " + same + " End."), (2, mixed), (3, q + " " + q), (4, "a tiny question here"), (5, None), (6, "nothing of the kind")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.report(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 4)} and got[1, 1]["changed"] and not got[3, 1]["changed"]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 5, 6]
    assert decontaminate.drop_leaks(edge, bench).count() == len(EDGE) and decontaminate.report(empty, bench).collect() == []
    assert decontaminate.drop_leaks(edge, bench.limit(0)).count() == len(EDGE)


def test_op2_other_lengths_of_names_and_numbers(spark):
    q = "At the market in the old town the baker Tom sold 1000 rolls to a trader from Paris who then walked along the river until the evening came and gave half of them to the children of the miller while Tom counted all the coins that were left in the small box under the table near the door."
    bench = spark.createDataFrame([(1, q)], "item_id long, text string")
    words = q.split()
    variants = [
        q.replace("Tom", "Mary Ann"), q.replace("Paris", "New York"), q.replace("1000", "2 500"), q.replace("Tom", "Anna Maria Schmidt").replace("Paris", "Rio").replace("1000", "7"),
        " ".join([*words[:28], "slowly", *words[28:]]), " ".join([*words[:28], *words[29:]]), " ".join([*words[:28], "slowly", *words[28:]]).replace("Tom", "Jean-Paul"),
    ]
    docs = spark.createDataFrame([(k, f"So it goes. {v} And on.") for k, v in enumerate(variants)], "doc_id long, text string")
    got = rows(decontaminate.report(docs, bench))
    assert set(got) == set(range(len(variants))) and [got[k]["changed"] for k in range(len(variants))] == [True] * 4 + [False] * 2 + [True]
    # on both sides of the word put in there must be one mapping
    two = [" ".join([*words[:28], "slowly", *words[28:]]).replace("Tom", n, 1) for n in ("Tom", "Igor")]
    held = rows(decontaminate.report(spark.createDataFrame(list(enumerate(two)), "doc_id long, text string"), bench))
    assert held[0]["windows"] > (held[1]["windows"] if 1 in held else 0)


def test_op2_poor_windows_and_short_items(spark):
    items = [
        "Compute 12 + 7 * 3 - 45 / 9 + 81.", "Who wrote the book about white whales?", "Anna Karl Otto Fritz, Berta Emil, 12 19 44 Hans 7 Ida 9 Jan 5 Kurt 3 Lena 8", "Mary Ann Smith owns 12 Ford Escorts",
        "Tell us Who of the Five Great Kings Of The North Led His Men Over The River To The West In 1204 And Came Back In 1210", "How many days did the 3 ships sail?",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [f"they asked {t} and then more" for t in items] + [f"It is said. {t.upper() if k != 3 else t.lower()}" for k, t in enumerate(items)]
    other = ["they asked How many days did the 9 ships sail? in vain", "Compute 12 + 8 * 3 - 45 / 9 + 81.", "Anna Karl Uwe Fritz, Berta Udo, 12 19 45 Hans 8 Ida 1 Jan 2 Kurt 4 Lena 6"]
    frame = spark.createDataFrame(list(enumerate(docs + other)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontaminate.report(frame, bench).collect()}
    assert got == {(k, k % 6): False for k in range(12)} | {(12, 5): True}
    wide = frame.withColumns({c: frame["text"] for c in ("__d_doc", "__d_key", "__d_row", "__d_hit", "hash", "item")})
    kept = decontaminate.drop_leaks(wide, bench)
    assert kept.columns == wide.columns and {r["doc_id"] for r in kept.collect()} == {13, 14} and all(r["__d_doc"] == r["text"] for r in kept.collect())


def test_op2_recall_of_questions_asked_anew(spark):
    """Questions with other names and numbers, also where names begin sentences; and none among texts of the same words."""
    import random

    rng = random.Random(8)
    names = "Alice Zelda Maria Igor Bruno Chen Dora Emil Farah Gus Hanna Ivo".split()
    things = "apples boxes letters coins tickets lamps ropes stones books cups".split()
    verbs = "bought sold carried counted painted moved dropped found packed shared".split()
    places = "market harbour bridge station garden castle library valley".split()

    def story(seed):
        r = random.Random(seed)
        return [(r.choice(verbs), r.choice(things), r.choice(places), r.choice(verbs), r.choice(things)) for _ in range(4)]

    def told(sentences, who, numbers):
        return " ".join(f"{who[i % 2]} {a} {numbers[i]} {t} near the old {p} and then {b} some of the {u} before it was late." for i, (a, t, p, b, u) in enumerate(sentences))

    items = [(k, told(story(k), rng.sample(names, 2), rng.sample(range(2, 99), 4))) for k in range(60)]
    again = [(k, "It was said. " + told(story(k), rng.sample(names, 2), rng.sample(range(100, 999), 4)) + " So it went.") for k in range(60)]
    other = [(100 + k, told(story(1000 + k), rng.sample(names, 2), rng.sample(range(2, 99), 4))) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(spark.createDataFrame(again + other, "doc_id long, text string"), bench).collect()}
    assert len({(k, k) for k in range(60)} & got) >= 54 and len({d for d, _ in got if d >= 100}) <= 3
    zelda = "Alice went to the river early to wash the sheets. Alice met nobody there but a grey cat. Alice came home at noon and slept until the evening bell."
    bench = spark.createDataFrame([(1, zelda)], "item_id long, text string")
    assert decontaminate.report(spark.createDataFrame([(1, zelda.replace("Alice", "Zelda")), (2, zelda.replace("Alice", "Zelda", 1).replace("Alice", "Bruno", 1))], "doc_id long, text string"), bench).filter("doc_id = 1").count() == 1


# 3
def levenshtein_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def plain_dedup(pairs, edit_chars=16):
    """Text per document, by comparing each line with all earlier ones; keys are unique."""
    seen, by_length, out = {}, defaultdict(list), {}
    order = sorted(((d is not None, d or 0), d, t) for d, t in pairs)
    firsts = []
    for _, d, t in order:
        for n, line in enumerate(t.split("\n") if t is not None else []):
            s = line.strip(" \t\r\x0b\x0c")
            if s and s not in seen:
                seen[s] = (d, n)
                firsts.append(s)
    near = set()
    for s in firsts:
        if len(s) >= edit_chars:
            for m in (len(s) - 1, len(s), len(s) + 1):
                # earlier lines alone have been filed so far
                if any(x[:8] == s[:8] or x[-7:] == s[-7:] for x in by_length[m]) and any(levenshtein_one(s, x) for x in by_length[m]):
                    near.add(s)
                    break
            by_length[len(s)].append(s)
    for _, d, t in order:
        if t is None:
            out[d] = None
            continue
        kept = []
        for n, line in enumerate(t.split("\n")):
            s = line.strip(" \t\r\x0b\x0c")
            if not s or (seen[s] == (d, n) and s not in near):
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_op3_against_all_earlier_lines(spark, sf, docs):
    want = plain_dedup(docs)
    for d, r in rows(queries.op3_line_dedup(spark, sf)).items():
        assert r["kept_sha256"] == hashlib.sha256(want[d].encode()).hexdigest(), d


def test_op3_edits_and_edges(spark, edge, empty):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abc "), 30)).strip() + "x" * 4 for _ in range(30)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(6):
            s = list(base[rng.integers(30)])
            for _ in range(rng.integers(0, 3)):
                p = int(rng.integers(len(s)))
                match rng.integers(3):
                    case 0: s[p] = "z"  # noqa: E701
                    case 1: del s[p]  # noqa: E701
                    case 2: s.insert(p, str(rng.choice(list("ab"))))  # noqa: E701
            lines.append("".join(s))
        texts.append((i, "\n".join(lines)))
    texts += [(100, None), (101, ""), (102, " \n\n"), (None, "a null key holds this line of text\nand one more line of its own")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = plain_dedup(texts)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
    assert got == want
    kept = {r["doc_id"] for r in line_dedup.keep_lines(df).collect()}
    assert kept == {d for d, t in want.items() if t is None or t.strip() or not dict(texts)[d].strip()}
    assert line_dedup.report(edge).count() == len(EDGE) and line_dedup.keep_lines(edge).columns == edge.columns
    assert line_dedup.report(empty).collect() == [] and line_dedup.keep_lines(empty).collect() == []


def test_op3_blocks_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        a = "".join(rng.choice(list("ab"), rng.integers(1, 40)))
        p, c = int(rng.integers(len(a))), str(rng.choice(list("ab")))
        b = [a[:p] + c + a[p + 1 :], a[:p] + a[p + 1 :], a[:p] + c + a[p:]][rng.integers(3)]
        for blocks in (2, 16):
            assert line_dedup.block_keys(a, blocks) & line_dedup.block_keys(b, blocks), (a, b)


# 4
def check_warc(pairs, got):
    digests, first = {}, {}
    for p, h in pairs:
        body = (h or "").encode()
        digests[p] = (len(body), hashlib.sha1(body).hexdigest())
        if len(body) >= 1000:
            first[digests[p]] = max(first.get(digests[p], p), p)
    for p, h in digests.items():
        original = first.get(h, p)
        assert tuple(got[p])[1:] == (*h, "response" if original == p else "revisit", None if original == p else original)


def test_op4_round_trip(spark, sf):
    own = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check_warc(own, rows(queries.op4_warc(spark, sf), "page_id"))


@pytest.mark.parametrize("version", [1, 2])
def test_op4_versions_and_edges(spark, version):
    big = "<p>größe\r\n\r\nWARC/1.1\n</p>" * 60
    own = [(1, "http://a b/ü", big), (2, None, big), (3, "http://c/", None), (4, "http://d/", "x" * 999), (5, "http://e/", "x" * 999), (-7, "http://f/", big), (9, "http://g/", "")]
    df = spark.createDataFrame([(*x, "extra") for x in own], "page_id long, url string, html string, digest string")
    check_warc([(p, h) for p, _, h in own], rows(archives.round_trip(df, version), "page_id"))
    again = spark.createDataFrame([(None, "u", big), (3, "u", big), (3, "u", big)], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in archives.round_trip(again, version).collect()) == [(0, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert archives.round_trip(df.limit(0), version).collect() == []


def test_op4_ids_and_bad_archives():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345, None):
        assert archives.page_of(archives.record_id(page, "u")) == page
    data = archives.arc_head("n", "20240101", 2) + archives.arc_record("http://x/", "20240101", "text/html", b"ab\ncd", 2) + b"\n\n"
    assert [b for _, b in archives.parse_arc(data)][1] == b"ab\ncd" and [archives.iso_date(d) for d in ("1999", "199907", "19990704", "19990704123456")] == ["1999-01-01T00:00:00Z", "1999-07-01T00:00:00Z", "1999-07-04T00:00:00Z", "1999-07-04T12:34:56Z"]
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-5]))
    page = archives.convert("http://x/", "1999", None, b"", b"png", "sha1:D", None, ip="1.2.3.4", mime="image/png")
    whole = archives.info_record(page) + page
    (info, _), (head, block) = archives.parse_warc(whole)
    assert (head["warc-type"], head["content-type"], head["warc-ip-address"], block) == ("resource", "image/png", "1.2.3.4", b"png")
    assert info["warc-record-id"] != archives.parse_warc(archives.info_record(page + b"x")).__next__()[0]["warc-record-id"]
    for cut in (whole[:-1], whole[:-6]):
        with pytest.raises(ValueError):
            list(archives.parse_warc(cut))


def test_op4_revisits_name_a_record(spark, tmp_path):
    import gzip

    own = [(1, "http://a b/", "x" * 2000), (2, None, "x" * 2000), (5, "http://e/", "x" * 2000), (5, "http://d/", "x" * 2000), (None, "http://n/", "x" * 2000), (7, "http://g/", "y" * 2000)]
    archives.write_arc(spark.createDataFrame(own, "page_id long, url string, html string"), f"file://{tmp_path}/arc")
    archives.arc_to_warc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    heads = [h for f in (tmp_path / "warc").glob("[!._]*") for h, _ in archives.parse_warc(gzip.decompress(f.read_bytes()))]
    there = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(there) == 3 and len(revisits) == 3
    for h in revisits:
        to = there[h["warc-refers-to"]]
        assert (h["warc-refers-to-target-uri"], h["warc-refers-to-date"], h["warc-payload-digest"]) == (to["warc-target-uri"], to["warc-date"], to["warc-payload-digest"])


# 5
def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(fps, bits=4):
    """fps: key to fingerprint; the smallest key of each component, all pairs compared."""
    values = np.array(sorted(set(fps.values())), np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            root[find(int(j))] = find(i)
    at = {int(v): find(i) for i, v in enumerate(values)}
    least = {}
    for k, f in fps.items():
        least[at[f]] = min(least.get(at[f], k), k)
    return {k: least[at[f]] for k, f in fps.items()}


def test_op5_against_all_pairs(spark, sf, docs):
    got = rows(queries.op5_simhash(spark, sf))
    fps = {d: plain_fingerprint(t) for d, t in docs}
    want = plain_components(fps)
    for d, f in fps.items():
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{f:016x}", want[d])


@pytest.mark.parametrize("hot", [256, 3])
def test_op5_links_of_planted_fingerprints(spark, hot):
    rng = np.random.default_rng(hot)
    fps = set()
    for _ in range(60):  # balls and chains about random centres
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(rng.integers(1, 60)):
            fps.add(x)
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
            if rng.random() < 0.3:
                x = y
    fps |= {int(v) for v in rng.integers(0, 1 << 63, 2000)} | {0, (1 << 64) - 1}
    own = {k: v for k, v in enumerate(sorted(fps))}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in own.values()], "fp long")
    label = {r["fp"] & (1 << 64) - 1: r["label"] for r in simhash.components(simhash.links(df, 4, hot)).collect()}
    want = plain_components(own)
    groups = defaultdict(set)
    for k, v in own.items():
        groups[label.get(v, ("own", v))].add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_op5_edges_and_keep_first(spark, edge, empty):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.group(edge).collect()]
    assert len(got) == len(EDGE) and {c for d, c in got if d in (1, 2, 3)} == {1} and {c for d, c in got if d in (5, 6)} == {5}
    assert {(r["doc_id"], r["text"]) for r in simhash.keep_first(edge).collect()} >= {(1, None), (None, "no key here"), (5, "a b c d e f g h")}
    kept = [r["doc_id"] for r in simhash.keep_first(edge).collect()]
    assert sorted(k for k in kept if k) == [1, 4, 5, 7, 8] and simhash.keep_first(edge).columns == edge.columns
    assert simhash.group(empty).collect() == [] and simhash.keep_first(empty).collect() == []


# 6
def test_op6_permutation_and_shards(spark, sf, docs, edge, empty):
    for n in (0, 1, 2, 3, 5, 16, 24, 25, 1000, 1001, 65537):
        p = sharding.permute(np.arange(n), n, seed=3)
        assert sorted(p.tolist()) == list(range(n))
    got = rows(queries.op6_sharding(spark, sf))
    place = sharding.permute(np.arange(len(docs)), len(docs))
    for i, (d, t) in enumerate(sorted(docs)):
        body = t.encode()
        assert tuple(got[d]) == (d, len(body) + 8, zlib.crc32(body), "rows", place[i] % 24, place[i] // 24, None)
    again = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet").repartition(5))
    assert rows(again) == got
    small = sharding.shard(edge).collect()
    assert len(small) == len(EDGE) and len({(r["shard"], r["slot"]) for r in small}) == len(EDGE) and {r["size"] for r in small if r["doc_id"] == 1} == {8}
    assert sharding.shard(empty).collect() == []


# 7
def test_op7_held_out_accuracy(spark, sf, edge, empty):
    from pyspark.sql import functions as F

    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = quality_model.grade(d, labels.filter(~test)).join(labels.filter(test), "doc_id").collect()
    right = np.mean([r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in scored])
    toxic = np.mean([not r["kept"] for r in scored if r["toxic"] == 1])
    clean = np.mean([r["kept"] for r in scored if r["quality"] == 1 and r["toxic"] == 0])
    assert right > 0.95 and toxic > 0.85 and clean > 0.97, (right, toxic, clean)
    assert quality_model.grade(edge, labels).count() == len(EDGE) and quality_model.grade(empty, labels).collect() == []
    none = quality_model.grade(edge, labels.limit(0)).collect()
    assert len(none) == len(EDGE) and len({round(r["expected_grade"], 9) for r in none}) == 1


def test_op7_scores_by_plain_sums(spark, edge):
    rng = np.random.default_rng(1)
    size = (1 << 18) + 50
    w, t = rng.normal(size=size).astype("<f4") * 0.1, np.array([-1.0, 0.5])
    for r in quality_model.score(edge, (w, t), 2).collect():
        want = []
        for d, text, *_ in EDGE:
            if d == r["doc_id"]:
                at, feature = quality_model.features([text or ""], 18)
                z = sum(float(w[f]) for f in feature)
                above = [1 - 1 / (1 + np.exp(-(x - z))) for x in t]
                want.append((sum(above), above[1]))
        assert any(abs(r["expected_grade"] - e) < 1e-4 and abs(r["tail_probability"] - p) < 1e-4 and r["kept"] == (r["tail_probability"] >= 0.5) for e, p in want)


def test_op7_ties_stay_within_the_bound(spark):
    rows_ = [(1, f"text number {i}", i % 2) for i in range(300)] + [(i, "good words here", 1) for i in range(2, 40)]
    rated = spark.createDataFrame(rows_, "doc_id long, text string, grade int")
    one = quality_model.fit(rated, 2, train_rows=50)
    two = quality_model.fit(rated.repartition(7), 2, train_rows=50)
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])


def test_op7_thresholds_are_ordered_and_learnt():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 2000)
    at, feature = [], []
    for i, g in enumerate(grades):
        own = {int(g), 10 + int(rng.integers(5))}
        at += [i] * len(own)
        feature += sorted(own)
    w, t = quality_model.fit_arrays(np.array(at), np.array(feature), grades, 32, 4)
    assert (np.diff(t) > 0).all() and (np.diff(w[:4]) > 0).all()


# 8
def test_op8_as_tiktoken(spark, sf, docs, edge, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})

    def check(pairs, got):
        for d, t in pairs:
            ids = own.encode_ordinary(t or "")
            assert tuple(got[d]) == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    check(docs, rows(queries.op8_bpe(spark, sf)))
    rng = np.random.default_rng(2)
    parts = [" ", "  ", "\n", "a", "b", "the", " the", "1", "23", "'s", "'", "!", "é", "\x1c", "日", "😀", "́", "\r\n", "\t", "\x85", "​", "﻿", "Ⅷ", "²", "<|endoftext|>", "=" * 40, "ab" * 50]
    texts = [(i, "".join(rng.choice(parts, rng.integers(0, 30)))) for i in range(1500)]
    texts += [(2000, None), (2001, "x" * 5000), (2002, " " * 3000 + "a"), (2003, "".join(rng.choice(list("abcdefgh"), 4000))), (2004, "abc" * 1500), (2005, "abcdefg" * 3000), (2006, "é日本ñ" * 3000)]
    # far longer than a chunk: letters that never break, and runs out of step with the chunks
    texts += [(2007, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))), (2008, "".join(rng.choice(["the", "ing", "ea", "x"], 20_000))), (2009, "aaaaaaab" * 4000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    check(texts, rows(bpe.digests(frame, path, public_tokenizers.PATTERN)))
    whole = rows(bpe.encode(frame, path, public_tokenizers.PATTERN))
    assert all(whole[d]["decoded"] == (t or "").encode() for d, t in texts)
    assert bpe.digests(edge, path, public_tokenizers.PATTERN).count() == len(EDGE) and bpe.digests(empty, path, public_tokenizers.PATTERN).collect() == []



def test_op8_steps_are_few():
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(["the", "ing", "on", "er", "que", "sch", "an", "ed", "ß", "ción"], 4)).encode() for _ in range(1000)]
    enc.merged(words)
    got = enc.db.sql(bpe.ENCODE[: bpe.ENCODE.rindex("SELECT word")] + "SELECT count(*) FROM step").fetchall()[0][0]
    # contracting one rank of a word a step made 4.9 rows a byte
    assert got < 4 * sum(map(len, words))


def test_op8_merges_as_one_by_one(tmp_path):
    import base64

    def plain(word, ranks):
        parts = [word[i : i + 1] for i in range(len(word))]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    # vocabularies in which long tokens may come before their parts, and many pairs overlap
    for seed in range(30):
        rng = np.random.default_rng(seed)
        letters = list("abcde"[: 2 + seed % 3])
        tokens = sorted({"".join(rng.choice(letters, rng.integers(2, 7))).encode() for _ in range(10 + 2 * seed)})
        rng.shuffle(tokens)
        if seed % 2:
            tokens.sort(key=len)
        ranks = {t: i for i, t in enumerate([*(bytes([i]) for i in range(256)), *tokens] if seed % 5 else [*tokens, *(bytes([i]) for i in range(256))])}
        (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        enc = bpe.Encoder(str(tmp_path / "ranks"), ".+")
        words = [b"a" * 17, *("".join(rng.choice(letters, n)).encode() for n in (1, 2, 3, 5, 8, 13, 30) * 10), "".join(rng.choice(letters, 500)).encode()]
        assert [g.tolist() for g in enc.merged(words)] == [plain(w, ranks) for w in words]
        ids, text = enc.encode(words), enc.decode(enc.encode(words))
        want = [[ranks[w]] if w in ranks else plain(w, ranks) for w in words]
        assert ids.lengths.tolist() == [len(w) for w in want] and ids.data.tolist() == sum(want, [])
        assert text.lengths.tolist() == [len(w) for w in words] and text.data.tobytes() == b"".join(words)


def test_op8_forgets_words_without_harm():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small, large = bpe.Encoder(path, public_tokenizers.PATTERN, cached=40), bpe.Encoder(path, public_tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice(list("abcdéf"), rng.integers(1, 9))) for _ in range(rng.integers(0, 40))) for _ in range(3)] + ["xy" * 3000]
        assert list(bpe._encoded(texts, small)) == list(bpe._encoded(texts, large))
    assert len(small.known) <= 40 + 120 and len(large.known) > 500


# 9
def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_op9_measures_and_cascade(spark, sf, docs, edge, empty):
    got = rows(queries.op9_quality_rules(spark, sf))
    for d, t in docs:
        want = plain_measures(t)
        assert tuple(got[d])[1:7] == want, d
        assert not (want[5] and got[d]["kept"])
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {d for d, r in got.items() if r["kept"]}
    assert {r["doc_id"] for r in quality_rules.judge(frame).collect()} == kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long = [d for d in labels if got[d]["n_words"] >= 50]
    assert all(d in kept for d in long if labels[d] == 1) and np.mean([d in kept for d in long if labels[d] == 0]) < 0.2
    text = "\n".join(["a b c"] * 300 + [" ".join(f"w{i}" for i in range(300))] * 2)
    hard = spark.createDataFrame([(1, text), (2, "x y"), (3, None)], "doc_id long, text string")
    for d, r in rows(quality_rules.report(hard)).items():
        assert tuple(r)[1:7] == plain_measures({1: text, 2: "x y", 3: None}[d])
    for r in quality_rules.report(edge).collect():
        assert tuple(r)[1:7] in {plain_measures(t) for d, t, *_ in EDGE if d == r["doc_id"]}
    assert quality_rules.judge(edge).columns == edge.columns and quality_rules.report(empty).collect() == [] and quality_rules.judge(empty).collect() == []


def plain_kept(text):
    """What the rules say, by plain Python."""
    import unicodedata

    n, chars, symbols, dup, _, failed = plain_measures(text)
    text = text or ""
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    caps, letters = (sum(unicodedata.category(c).startswith(k) for c in text) for k in ("Lu", "L"))
    return not (failed or chars < 2 * n or chars > 15 * n or 10 * symbols > n or (dup >= 3 and 10 * dup > 3 * lines) or 10 * caps > 4 * letters or 10 * letters < 6 * chars)


def test_op9_verdict_by_plain_rules(spark, sf, docs):
    got = rows(queries.op9_quality_rules(spark, sf))
    wrong = [d for d, t in docs if got[d]["kept"] != plain_kept(t)]
    assert not wrong and 0 < sum(r["kept"] for r in got.values()) < len(got)


def test_op9_best_rate_first(spark):
    texts = ["### *** $$$ %%% " * 30 + f"word{i}" for i in range(40)] + [" ".join(f"word{i}{j}" for j in range(60)) for i in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [r.name for r in quality_rules.order_rules(frame)]
    assert set(order) == {r.name for r in quality_rules.BASE + quality_rules.FURTHER} and order.index("too_short") > order.index("symbols")


# 10
def test_op10_files(spark, sf, docs, edge, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True

    def check(pairs, got):
        start = 0
        for d, t in pairs:
            ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
            assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), d
            start += len(ids)

    check(sorted(docs), rows(queries.op10_token_files(spark, sf)))
    texts = [(-5, "a  b\n c <|endoftext|>"), (3, None), (10, "naïve 日本 😀 \t x"), (2**40, "w " * 3000)]
    frame = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, part int, start int").repartition(3)
    check(texts, rows(token_files.round_trip(frame, path)))
    small = token_files.round_trip(edge, path).collect()
    assert len(small) == len(EDGE) and min(small, key=lambda r: r["start"])["doc_id"] is None
    assert token_files.round_trip(empty, path).collect() == []


def test_op10_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["a <|endoftext|> b", "plain words", end, end * 3, f"x{end}y", f" {end}\n {end} ", "<|endoftext|", "<|ENDOFTEXT|> x", f"le  café{end} 日本 <|endof{end}text|>", "", "a <|endoftext |> b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, start = rows(queries.op10_token_files(spark, str(tmp_path))), 0
    for d, t in enumerate(texts):
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


class Counting:
    """A tokenizer that counts what it is given."""

    def __init__(self, own):
        self.own, self.strings, self.characters = own, 0, 0

    def _counted(self, method, texts, options):
        self.strings += len(texts)
        self.characters += sum(map(len, texts))
        return getattr(self.own, method)(texts, **options)

    def encode_batch(self, texts, **options):
        return self._counted("encode_batch", texts, options)

    def encode_batch_fast(self, texts, **options):
        return self._counted("encode_batch_fast", texts, options)


def test_op10_library_gets_pieces_by_the_hundreds_and_once():
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(3000)]
    own = token_files.Words(public_tokenizers.path("byte_bpe_50k.json"), 20_000, True)
    own.tokenizer = given = Counting(own.tokenizer)
    token_files.encode_texts(["x\n" + "\n".join(names), "x " + " ".join(names)], own)
    assert given.strings < 100
    before = given.characters
    token_files.encode_texts(["x " + ", ".join(names) + ".\nx", "x" + "".join(f"\n{n}!" for n in names)], own)
    assert given.characters - before < 100


def test_op10_texts_at_borders():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(5)
    atoms = ["a", "Foo", "don't", "'s", "'", "\n", "\n", "\n\n", " \n", "\n ", "\r\n", "\t", " ", " ", " ", "  ", ",", ".", "%%%", "12", "²", "é", "日本", "😀", "\u0301", "\xa0", "\x1c", "\x85", "ꟊ", "\U0001df00", "<|endoftext|>", "\u200b", "x" * 40]
    texts = ["".join(rng.choice(atoms, n)) for n in rng.integers(0, 40, 3000)] + ["", "\n", " ", "a\nb", "a\n\nb\nc", "a \nb", "\na", "a\n"]
    own = token_files.Words(path, 300, True)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u2").tolist() for x in token_files.encode_texts(part, own)] == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


def test_op10_no_python_for_each_piece():
    import sys

    own, calls = token_files.Words(public_tokenizers.path("byte_bpe_50k.json"), 20_000, True), [0]
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    texts = ["x " + ", ".join(names) + ".\nx", "x" + "".join(f"\n{n}" for n in names)]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = token_files.encode_texts(texts, own)
    finally:
        sys.setprofile(None)
    assert calls[0] < 5000 and [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_op10_pieces_kept_are_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KEPT_BYTES", 4000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), token_files.Words(path, 50, True)
    often = "the same words, in each block. "
    for k in range(30):
        # many short pieces and a long one in turn; every character up to U+024F before a mark
        texts = [often + " ".join(f"w{k}{i}!" for i in range(200)), "", often + f"{k}é" * 1500, " ".join(f"a{chr(c)}, {chr(c)}{k}" for c in range(k * 20, k * 20 + 20)), "\u0250. ɏ. ꟊ. 日, 😀!"]
        assert [np.frombuffer(x, "<u2").tolist() for x in token_files.encode_texts(texts, own)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert 50 <= len(own.known) <= 100 and own.known.nbytes <= 8000 and len(own.known) == len(own.found.lengths) == len(own.used)


def test_op10_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 0), (1, 10**12), (5, 3), (1000, 10), (1000, 10**9), (3000, 4000), (700, 2**62)):
        values = np.sort(rng.integers(0, u + 1, n))
        ef = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.of(values).to_bytes()))
        assert ef.all().tolist() == values.tolist() and [ef.select(i) for i in range(n)] == values.tolist()
        if n >= 700:
            assert len(ef.to_bytes()) * 8 <= n * (3 + max(0, np.log2(u / n))) + 600
    f = token_files.TokenFile(token_files.pack(0, 0, [None, 5, 5, 9], [2, 1, 3, 1], np.arange(7, dtype="<u2").tobytes(), 2))
    assert f.keys() == [None, 5, 5, 9] and [f.ids_of(i).tolist() for i in range(4)] == [[0, 1], [2], [3, 4, 5], [6]]


# pipeline
def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline
    import tiktoken

    sf = "/root/testdata/sf0.001"
    own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in quality_rules.report(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["kept"]}
    docs = [(d, t) for d, t in own if d in kept]
    lines = {d: t for d, t in plain_dedup(docs).items() if t.strip()}
    first = plain_components({d: plain_fingerprint(t) for d, t in lines.items()})
    squeeze = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    left = {d: t for d, t in lines.items() if first[d] == d and not any(squeeze(i) in squeeze(t) for i in items)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {d: (len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in left.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_pipeline_leaves_only_live_tables(spark, tmp_path, monkeypatch):
    """The stages delete what they settled: when a run is over, its last input alone is left."""
    import corpus_pipeline
    from pagemill.llm import _base

    monkeypatch.setattr(_base, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["pipeline-decontamination"]


LONG = " ".join(f"word{i} goes on and on" for i in range(20_000))
PROSE = "A line of prose that every rule keeps as it has words enough and none of them again. " + " ".join(f"{a}{b}" for a in "bdfglmnprst" for b in ("ain", "ost", "ilk", "arp", "une"))
STAGE_ROWS = [
    (1, None, "n"), (2, "", "e"), (3, PROSE, "p"), (3, PROSE, "p"), (4, PROSE, "same text, another key"), (None, PROSE + " More of it.", None), (5, LONG, "long"), (6, "short", "s"), (7, "short", "s"),
]
#: Keys left by each stage of rows with null, empty, repeated and very long texts.
STAGE_KEYS = {
    "quality_rules": [None, 3, 3, 4], "line_dedup": [None, 1, 2, 3, 3, 5, 6], "simhash": [None, 1, 3, 5, 6], "decontamination": [None, 1, 2, 3, 3, 4, 5, 6, 7],
}


@pytest.mark.parametrize("name", list(STAGE_KEYS))
def test_stages_on_odd_rows(spark, name):
    import corpus_pipeline

    clashing = ["__l_id", "__l_doc", "__l_row", "__s_at", "__s_key", "__d_row", "__d_doc", "__d_key", "__q_text", "__q_words", "fp", "component_id", "at", "key", "same", "x"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in clashing)
    frame = spark.createDataFrame([(*r, *["v"] * len(clashing)) for r in STAGE_ROWS], schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, frame, "/root/testdata/sf0.001")
    assert got.columns == frame.columns
    kept = got.collect()
    assert sorted((r["doc_id"] for r in kept), key=lambda k: (k is not None, k or 0)) == STAGE_KEYS[name]
    assert {tuple(r[c] for c in clashing) for r in kept} == {("v",) * len(clashing)}
    empty = stage(spark, frame.limit(0), "/root/testdata/sf0.001")
    assert empty.columns == frame.columns and empty.collect() == []


def test_last_stage_on_odd_rows(spark):
    import corpus_pipeline

    frame = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, ids string")
    stage = corpus_pipeline.STAGES[-1][1]
    got = sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in stage(spark, frame, "").collect())
    assert got == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in STAGE_ROWS) and stage(spark, frame.limit(0), "").collect() == []
