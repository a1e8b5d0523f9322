import hashlib
import random
import re

from pyspark.sql import functions as F

from orderloom.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = [(m, re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
    out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "x@y", ".", "_", "%", "com", "1", "25", "255", "256", "007", " ", "-", "4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "+", "(", "é\U0001f600", "\n", "10.0.0.1", "a@b.c_d@e.f"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), 1) for i in range(600)]
    rows += [(700, None, 1), (701, "", 1), (None, "x@y.z", 1), (702, "9" * 50_000 + " 1" * 20_000 + "a@" + "b." * 20_000 + "z", 1), (703, "a" * 100_000 + "1." * 50_000, 1), (704, "x@y.z", 1), (704, "x@y.z", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, base int").write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.op9_personal_data(spark, str(tmp_path)).collect()
    want = {}
    for i, t, _ in rows:
        spans = base_spans(t or "")
        want[i] = ([sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], ",".join("%s:%d:%d" % s for s in spans))
    assert len(out) == len(rows)
    for r in out:
        counts, spans = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (r.spans + ",").startswith(spans and spans + ",")


def test_weak_supervision_on_labelled_spans(spark):
    """Planted spans of the wider kinds, true and false; the classifier must tell them apart without their labels."""
    rng, rows, truth = random.Random(8), [], {}
    for i in range(400):
        true = rng.random() < 0.6
        area = rng.randint(200, 989) if true else rng.choice([0, 100, 199])
        tel = f"{area:03d}-{rng.randint(200, 999)}-{rng.randint(0, 9999):04d}"
        lead = rng.choice(["please call ", "my phone is ", "tel: "]) if true else rng.choice(["see part no ", "order "])
        truth[i] = true
        rows.append((i, f"words {lead}{tel} more. mail me at x{i}@mail.com"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_candidates(df)
    model = pii.fit(found)
    got = {r.doc_id: len(r.wider) == 1 for r in pii.with_personal_data(found, model).collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 0.95 * len(truth)
    true_rate, false_rate = model.reliability["context"]
    assert true_rate > 0.8 > false_rate


def planted(rng):
    """kind, whether true, words before, span, words after."""
    n = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    name, far = rng.choice(["Anna", "Hans", "Mary", "Luis"]), rng.choice(["Blorp", "Quux", "Zandt"])
    good = rng.random() < 0.6
    plain = rng.random() < 0.1  # words that say nothing
    lead = lambda yes, no: rng.choice(["then"] if plain else yes if good else no) + " "
    kind = rng.choice(["at_email", "ssn", "iban", "tel", "name", "street"])
    if kind == "at_email":
        return (kind, True, lead(["mail me at", "contact"], ["mail"]), f"{far.lower()}{n(2)} [at] site.{rng.choice(['com', 'de', 'org'])}", ".") if good else (kind, False, "see ref ", f"{far.lower()} [at] step.{n(2)}x", "")
    if kind == "ssn":
        return kind, good, lead(["her ssn", "social security no is", "the patient"], ["part", "invoice", "order"]), f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" if good else f"9{n(2)}-00-{n(4)}", " and"
    if kind == "iban":
        land, body = rng.choice(["DE", "FR", "GB"]) if good else rng.choice(["XQ", "GB"]), f"NWBK{n(4)}{n(4)}{n(2)}"
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
        check = check if good else (check + rng.randint(1, 50)) % 97
        whole = f"{land}{check:02d}{body}"
        return kind, good, lead(["account", "iban"], ["serial", "sku"]), " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)), ","
    if kind == "tel":
        return kind, good, lead(["call", "my phone:", "tel"], ["order", "part no"]), f"{rng.randint(200, 989)}-{rng.randint(200, 999)}-{n(4)}" if good else f"0{n(2)}-{n(3)}-{n(4)}", " now"
    if kind == "name":
        return kind, good, lead(["the customer", "patient", "address of"], ["chapter", "figure"]), f"Dr. {name} {far}" if good else f"Dr. {far}", " is"
    return kind, good, lead(["he lives at", "address:", "born at"], ["section", "page"]), f"{rng.randint(1, 999)} {far} {rng.choice(['Street', 'Road', 'Lane'])}", " here"


def test_every_wider_kind(spark):
    """Precision and recall over planted spans of all wider kinds, and of each."""
    rng = random.Random(12)
    cases = [planted(rng) for _ in range(900)]
    rows = [(i, f"words {lead}{span}{after} more words") for i, (_, _, lead, span, after) in enumerate(cases)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pii.with_candidates(df)
    model = pii.fit(found)
    got = {(r.doc_id, s.start, s.end, s.kind) for r in pii.with_personal_data(found, model).collect() for s in r.wider}
    want = {(i, 6 + len(lead), 6 + len(lead) + len(span), kind) for i, (kind, good, lead, span, _) in enumerate(cases) if good}
    hit = len(got & want)
    assert hit >= 0.95 * len(want) and hit >= 0.95 * len(got), (hit, len(want), len(got))
    for kind in ("at_email", "ssn", "iban", "tel", "name", "street"):
        w, g = ({x for x in s if x[3] == kind} for s in (want, got))
        assert len(w & g) >= 0.9 * len(w) and len(w & g) >= 0.85 * len(g), (kind, len(w & g), len(w), len(g))
    rates = {r.labeler: (r.for_true, r.for_false) for r in pii.report(spark, model).collect()}
    assert rates == model.reliability and rates["context"][0] > rates["context"][1]


def test_posterior_against_plain_arithmetic(spark):
    prior, reliability = {"ssn": 0.4}, {"shape": (0.9, 0.2), "context": (0.7, 0.1)}
    row = spark.createDataFrame([("ssn", 1, -1)], "kind string, shape int, context int").select(pii.posterior(prior, reliability).alias("p")).first()
    true, false = 0.4 * 0.9 * 0.3, 0.6 * 0.2 * 0.9
    assert abs(row.p - true / (true + false)) < 1e-12


def test_clean_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "The chapter 12 has 345 words, 10.5 of them in version 1.2.3.")], "doc_id long, text string")
    found = pii.with_candidates(df)
    row = pii.with_personal_data(found, pii.fit(found)).first()
    assert row.base == [] and row.wider == []
    none = pii.with_candidates(df.where(F.lit(False)))
    assert pii.with_personal_data(none, pii.fit(none)).count() == 0


def test_columns_that_clash_are_replaced(spark):
    df = spark.createDataFrame([(1, "x@y.com", 5, 6)], "doc_id long, text string, base int, wider int")
    found = pii.with_candidates(df)
    assert sorted(found.columns) == ["base", "doc_id", "text", "wider"] and found.first().base[0].kind == "email"
