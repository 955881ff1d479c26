import hashlib
import random
import re

from pyspark.sql import types as T

from sketchwell.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        x = "".join(rng.choice("ab@@..-+1234 0() é\n") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(x)) == brute(x), x


def test_disguises_map_back_to_the_source():
    for text, kind, part in [
        ("or joe [at] site [dot] com now", "email", "joe [at] site [dot] com"),
        ("joe at site dot com", "email", "joe at site dot com"),
        ("x аdmin@exаmple.com x", "email", "аdmin@exаmple.com"),
        ("é " + "four " + " ".join(["one"] * 15), "card", "four " + " ".join(["one"] * 15)),
        ("go to 1 dot 2 dot 3 dot 4 now", "ip", "1 dot 2 dot 3 dot 4"),
    ]:
        base, spans = pii.all_spans(text)
        assert base == [] and [(k, text[s:e]) for k, s, e in spans] == [(kind, part)]
    assert pii.all_spans("the dot at the end. One two, at home")[1] == []


def test_long_runs_stay_linear():
    assert pii.all_spans("1" * 300_000)[0] == [] and pii.all_spans("a" * 300_000 + "@")[0] == []


def test_query_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, spans int, n_email string"
    rows = [(1, None, 1, "x"), (2, "", None, None), (None, "a@b.cd", 2, "y"), (3, "a@b.cd 1.2.3.4", 3, ""), (3, "a@b.cd 1.2.3.4", 3, "")]
    for part, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{part}/documents.parquet")
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["spans"], r["base_sha256"]) for r in pii.op6_pii(spark, f"{tmp_path}/full").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = "email:0:6,ip:7:14"
    assert got == {(1, 0, 0, "", sha("")), (2, 0, 0, "", sha("")), (None, 1, 0, "email:0:6", sha("email:0:6")), (3, 1, 1, both, sha(both))}
    assert pii.op6_pii(spark, f"{tmp_path}/none").count() == 0
    assert isinstance(pii.op6_pii(spark, f"{tmp_path}/none").schema["n_card"].dataType, T.LongType)


def test_redact_merges_overlaps():
    assert pii.redact("a 1.2.3.4 b", [("ip", 2, 9), ("card", 4, 9)]) == "a <IP> b"


def test_disguises_beside_base_spans_are_whole():
    for text, kind, redacted in [
        ("jоhn@example.com", "email", "<EMAIL>"),
        ("to john@mail.example dot com now", "email", "to <EMAIL> now"),
        ("at \uff1192.168.1.1 now", "ip", "at <IP> now"),
    ]:
        base, spans = pii.all_spans(text)
        assert [k for k, *_ in base] == [kind] and set(base) < set(spans)
        assert pii.redact(text, spans) == redacted


def test_every_token_is_hinted():
    for text in ["john [ @ ] example.com", "john[at ]example.com", "john@example[ . ]com", "john@example(. )com", "john[at)example{ dot]com", "john@example( Dot)com"]:
        assert pii.redact(text, pii.all_spans(text)[1]) == "<EMAIL>", text
    rng = random.Random(8)
    for _ in range(30_000):
        x = "".join(rng.choice(["[", "( ", "{", " ", "at", "AT", "@", ".", "dot", " ]", ")", "}", "a", "1", "one", "oh", "Two", "-"]) for _ in range(rng.randint(0, 14)))
        if pii._TOKENS.search(x):
            assert any(h in x.lower() for h in pii._WORD_HINTS) or pii._HINT.search(x.lower()), x


def test_short_runs_of_spelled_digits_beside_dots_and_digits():
    for text, kind in [("1 dot two dot 3 dot 4", "ip"), ("one dot one dot two dot two", "ip"), ("one nine [dot] 1.2.oh", "ip"), ("one.two.one.two", "ip")]:
        assert [(k, text[s:e]) for k, s, e in pii.all_spans(text)[1]] == [(kind, text)], text
    assert pii.all_spans("4111 1111 1111 111 one")[1] == [("card", 0, 22)]


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op6_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in found) for k in pii.KINDS]
        order = sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r["spans"].split(",")) | {""}


def test_very_long_text():
    text = "plain words here " * 50_000 + "joe [at] site [dot] com " + "1.2.3.4 " + "more " * 50_000
    base, spans = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", "joe [at] site [dot] com "[:-1]), ("ip", "1.2.3.4")] and [k for k, *_ in base] == ["ip"]


def test_wider_disguises():
    for text, kind, part in [
        ("or john<at>example<dot>com now", "email", "john<at>example<dot>com"),
        ("or john-at-example-dot-com now", "email", "john-at-example-dot-com"),
        ("or john.b at example.com now", "email", "john.b at example.com"),
        ("mail: john at mail.example.org.", "email", "john at mail.example.org"),
        ("call plus one two three four five six seven eight nine zero one", "phone", "plus one two three four five six seven eight nine zero one"),
        ("card " + ", ".join(["four"] + ["one"] * 15), "card", ", ".join(["four"] + ["one"] * 15)),
        ("card 4111_1111_1111_1111 now", "card", "4111_1111_1111_1111"),
        ("on \u0661.\u0662.\u0663.\u0664 now", "ip", "\u0661.\u0662.\u0663.\u0664"),
        ("to +\u0967\u0968\u0969 456 789 01", "phone", "+\u0967\u0968\u0969 456 789 01"),
    ]:
        base, spans = pii.all_spans(text)
        assert base == [] and [(k, text[s:e]) for k, s, e in spans] == [(kind, part)], (text, spans)


def test_clean_texts_stay_clean():
    for text in [
        "We meet people at example.com and look at docs.example.org/start, at noon.",
        "One, two, three and four at the polka-dot-dress shop, plus one more, plus 3.",
        "The constant 1_000_000 and a_b at least; look <at> this, a look-at-me moment.",
        "See you all at Example.com tomorrow, at 10.30 at the latest.",
        "\u0661\u0669\u0668\u0664 \u0648 \u0662\u0660\u0662\u0664",
    ]:
        assert pii.all_spans(text) == ([], []), text


def test_ties_are_ordered_by_kind_and_end():
    spans = pii.all_spans("1.2.3.4@site.com")[1]
    assert spans == [("email", 0, 16), ("ip", 0, 7)]


def test_digits_beyond_the_basic_plane():
    text = "x \U0001d7d2111 1111 1111 111\U0001d7cf y"
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text)[1]] == [("card", text[2:-2])]
