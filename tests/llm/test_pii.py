import hashlib
import math
import random
import re

from tremolite.llm import pii
from tremolite.llm.common import read


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def slow(text):
    num = lambda s: re.sub("[^0-9]", "", s)
    pats = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(num(s)) <= 19 and luhn(num(s))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(num(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(pats) for m in re.finditer(p, text or "") if ok(m[0]))


def card(rng):
    d = "".join(rng.choices("0123456789", k=15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts(n):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "_d@e.f", ".", "..", "1.2.3.4", "256.1.1.1", "001.002.3.255.", "+1 (376) 555-9077", "+49-30", "+", "(", " ", "  ", "-", "--", "é", "𝄞", "\n", "7", "12", "999999999999999", "word", "A-Z"]
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 9)):
            c = card(rng)
            out.append(rng.choice([*bits, c, "-".join(c[i : i + 4] for i in range(0, 16, 4)), " ".join(c[i : i + 4] for i in range(0, 16, 4)), c + rng.choice("0123 -")]))
        yield "".join(out)


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate([*texts(1500), None, "", "9" * 60_000, "a." * 20_000 + "@" + "b.c" * 20_000, "1 " * 30_000 + "1.1" * 9000])]
    got = {r["doc_id"]: r for r in pii.scan_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows:
        want = slow(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t, text, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)]


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.scan_pii(docs).collect()}
    assert got == {r["doc_id"]: hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in slow(r["text"])).encode()).hexdigest() for r in docs.collect()}


def test_disclosing_terms_go(spark):
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor".split()
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choices(fill, k=n))
    rows = [(i, f"{some(30)} the Falconer 4711 lorem wrote from jo@mail.example.com {some(30)}", "x") for i in range(6)]
    rows += [(100 + i, f"{some(40)} the {some(9)} user{i}@mail.example.com {some(20)}", "x") for i in range(40)]
    rows += [(200, "Falconers 4711x the end", "x"), (None, None, "x"), (201, "", "x"), (202, "é " * 40_000, "x")]
    rows += [(300, f"copycat word one{i}@mail.example.com", "x") for i in (0, 0, 0, 0)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and len(out.columns) == 5
    for i in range(6):
        text, clean = got[i]["text"], got[i]["clean"]
        assert "jo@" not in clean and "[EMAIL]" in clean and "Falconer" not in clean and "4711" not in clean and "the" in clean
        assert [text[s["start"] : s["end"]] for s in got[i]["spans"]][:2] == ["Falconer", "4711"]
    assert got[200]["clean"] == rows[46][1] and got[None]["clean"] is None and got[201]["clean"] == ""
    assert got[300]["clean"] == "copycat word [EMAIL]"
    assert pii.scan_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_go_at_every_place_of_every_text(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices("lorem ipsum dolor sit amet elit sed tempor".split(), k=n))
    rows = [(i, f"Falconer {some(60)} jo@mail.example.com {some(60)} falconer x{i} FALCONER") for i in range(2)]
    rows += [(10 + i, f"{some(50)} user{i}@mail.example.com {some(9)} once{i}") for i in range(60)]
    rows += [(80, f"{some(20)} Falconer, {some(30)} (falconer)"), (81, "falconers xfalconer"), (82, "É falconer 𝄞 falconer")]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in rows:
        want = [m.span() for m in re.finditer(r"\bfalconer\b", t, re.I)]
        assert [(s["start"], s["end"]) for s in got[i]["spans"] if s["kind"] >= 4] == want, got[i]["clean"]
        assert not re.search(r"\bfalconer\b", got[i]["clean"], re.I) and (i < 10 or got[i]["clean"].endswith(t[-9:]) or want)
    assert got[10]["clean"].endswith("once0")


def test_copies_and_repeats_change_no_share(spark):
    few = [(i, f"{'kestrel ' * 10} a{i} jo@mail.example.com") for i in range(3)] + [(10 + i, f"plain text {i} u{i}@x.example") for i in range(60)]
    told = lambda rows: {(s["start"], s["kind"]) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").collect() for s in r["spans"]}
    assert told(few) == told(few + few[:1] * 1000) and len(told(few)) == 11


def test_near_copies_disclose_nothing(spark):
    """Many words are shared by near copies that hold one entity; none is a term, not even in other texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    body = [word() for _ in range(120)]
    rows = []
    for i in range(12):
        copy = list(body)
        copy[rng.randrange(120)] = word()
        rows.append((i, " ".join(copy) + " a@mail.example.com"))
    rows += [(100 + i, " ".join(word() for _ in range(60)) + f" u{i}@mail.example.com") for i in range(60)]
    rows += [(200, f"{body[3]} stays as {body[70]} does")]
    # Two classes of near copies share one entity and one word: that one discloses it.
    rows += [(300 + 10 * k + i, " ".join([f"top{k}{i}", *[f"w{k}x{j}" for j in range(60)], "heron", "b@mail.example.com"])) for k in range(2) for i in range(3)]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {s["value"] for r in got.values() for s in r["spans"] if s["kind"] >= 4}
    assert terms == {"heron"} == set(plain_terms([t for _, t in rows]))
    assert got[200]["clean"] == rows[72][1]


def plain_terms(texts):
    """The disclosing terms by plain counts: near copies are texts that share half of their three-word runs."""
    texts = sorted({t for t in texts if t})
    entities = [{t[a:b] for a, _, b in slow(t)} for t in texts]
    rest = []
    for t in texts:
        for a, _, b in slow(t):
            t = t[:a] + " " * (b - a) + t[b:]
        rest.append([w.lower() for w in re.findall(r"[^\W_]+", t)])
    n, t_count, pairs, holders = max(2, len(texts) - 1), {}, {}, {}
    for k, ws in enumerate(rest):
        for w in {w for w in ws if len(w) >= 3}:
            t_count[w] = t_count.get(w, 0) + 1
            for e in entities[k]:
                pairs.setdefault((e, w), []).append(k)
        for e in entities[k]:
            holders.setdefault(e, []).append(k)
    runs = lambda k: {tuple(rest[k][i : i + 3]) for i in range(len(rest[k]))}

    def unlike(ks):
        first = runs(ks[0])
        return any(2 * len(first & runs(k)) <= len(runs(k)) for k in ks[1:])

    out = {}
    for (e, w), ks in pairs.items():
        others = len(holders[e]) - 1
        if len(ks) > 1 and unlike(ks):
            share = math.log2((len(ks) - 1) * n / (others * (t_count[w] - 1))) / max(math.log2(n / others), 1e-9)
            if share >= pii.GENERALISE:
                out[w] = max(out.get(w, 0), share)
    return out


def test_terms_of_a_whole_table_match_plain_counts(spark, sf):
    """A whole table, with entities that also stand in other texts beside a word of their own."""
    docs = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    held = [t for _, t in docs if t and slow(t)]
    docs += [(10_000_000 + i, f"{t[a:b]} belongs to kestrelov{i % 2} and to number {i}") for i, t in enumerate(held[:20]) for a, _, b in slow(t)[:1]]
    docs += [(20_000_000 + i, f"quite another text, kestrelov{i % 2}, for {t[a:b]} in line {i}") for i, t in enumerate(held[:2]) for a, _, b in slow(t)[:1]]
    got = pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).selectExpr("explode(spans) as s").where("s.kind > 3")
    assert {r[0] for r in got.select("s.value").distinct().collect()} == set(plain_terms([t for _, t in docs]))


def test_stage_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    rows = [(2**53 + 1, "write to jo@mail.example.com", 28, 1, "b", None, "x", 4), (None, None, 0, 2, "", None, None, None), (5, "", 0, 3, "", None, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, terms int, text_hash string, base string, spans string, kin long")
    out = corpus_pipeline.personal_data(spark, docs, "")
    assert out.columns == docs.columns
    want = [(2**53 + 1, "write to [EMAIL]", 16, 1, "b", None, "x", 4), rows[1], rows[2]]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[3]) == want
