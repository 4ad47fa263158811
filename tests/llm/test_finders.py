"""Operators 1, 7 and 8: licenses, personal data, secrets."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from util import awkward, documents, empty

from fathomgraph.llm import licenses, pii, secrets

# ---- secrets


def test_secret_base_forms():
    text = 'Password = "abcdefghijkl" token:short api_key=AKIA1234567890ABCD x 0123456789abcdef secret:\'a.b/c+d=e_f-g'
    assert [(k, text[s:e]) for k, s, e in secrets.base_spans(text)] == [
        ("assign", 'Password = "abcdefghijkl'), ("assign", "api_key=AKIA1234567890ABCD"), ("access", "AKIA1234567890ABCD"), ("hex", "0123456789abcdef"), ("assign", "secret:'a.b/c+d=e_f-g"),
    ]
    assert secrets.base_spans("paſsword=abcdefghijkl toKen=abcdefghijklm") == []
    assert secrets.base_spans("AKIA12345 0123456789abcde token=abc") == []


def brute_base(text):
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_secret_base_forms_of_random_texts():
    rng = random.Random(6)
    parts = ["password", "TOKEN", "api_key", "apikey", "=", ":", '"', "'", " ", "a1b2c3d4", "e5f6", "AKIA", "ABCDEF0123", "é", ".", "\n", "zzz", "0123456789abcdef", "secretsecret"]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert secrets.base_spans(text) == brute_base(text)


def test_markov_ratio_on_held_out_samples():
    keys, names = secrets.built_in_samples(seed=1)
    model = secrets.MarkovPair(secrets.count_transitions(keys), secrets.count_transitions(names))
    keys, names = secrets.built_in_samples(seed=2, each=400)
    long_names = [n for n in names if len(n) >= secrets.MIN_RUN]
    caught = sum(model.score(k) > secrets.MIN_RATIO for k in keys) / len(keys)
    wrong = sum(model.score(n) > secrets.MIN_RATIO for n in long_names) / len(long_names)
    assert caught > 0.95 and wrong < 0.01


def test_secrets_of_documents(spark):
    rng = random.Random(8)
    key = "".join(rng.choices(secrets.ALPHABET[:62], k=40))
    plain = "the internationalization_of_configuration and getCustomerAccountDefaultValue were understandablenesses"
    rows = [(k, f"{plain} number {k}", "en", "s") for k in range(30)] + [(100, f"see {key} there, é {key}", "en", "s"), (101, "token=abcdefghijkl ok", "en", "s")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert got[100] == [("markov", key)] * 2 and got[101] == [("assign", "token=abcdefghijkl")] and not any(got[k] for k in range(30))
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.filter("doc_id = 100").first()["text"] == "see [secret] there, é [secret]"


def test_secrets_awkward(spark):
    docs = awkward(spark)
    got = secrets.find_secrets(docs).collect()
    assert len(got) == docs.count() and not any(r["spans"] for r in got)
    assert secrets.find_secrets(empty(spark)).count() == 0 and secrets.redact_secrets(empty(spark)).count() == 0
    assert secrets.redacted("abcdef", [("x", 1, 3), ("y", 2, 4)], "#") == "a#ef"


# ---- personal data


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(spark)


def luhn(digits):
    values = [int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def brute_personal(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_personal_base_forms(spark):
    rng = random.Random(7)
    parts = ["a.b", "x%", "@", "mail", ".com", ".", "1.2.3.4", "255", "256.", "0001", "4111 1111", "1111-1111", "4111111111111111", "+1 (375) 555-4393", "+49", " ", "-", "é😀", "\n", "9", "30", "word "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(22))) for _ in range(400)]
    texts += ["a@b.c%d@e.f", "x@y@z.com", "1.2.3.4.5.6.7.8", "+1 234 567 8 +", "9" * 30_000, "1 " * 40_000, "a." * 30_000 + "@b.c" + ".d" * 20_000, "+" * 5000, "1.1.1.1 " * 3000]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    got = docs.select("doc_id", pii.base_spans(F.col("text")).alias("spans")).collect()
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute_personal(texts[r["doc_id"]])


def test_trees_on_held_out_sentences(spark, trees):
    rows = pii.training_sentences(spark, 40).filter("copy > 30")  # other copies than those of training
    docs = rows.select(F.xxhash64("sentence").alias("doc_id"), F.col("sentence").alias("text"), "low", "high")
    found = pii.find_personal(docs, trees).join(docs, "doc_id")
    hits = found.select("low", "high", F.exists(F.concat(F.transform("base", lambda s: s["start"]), F.transform("added", lambda s: s["start"])), lambda x: x >= 0).alias("any")).collect()
    personal, plain = [r["any"] for r in hits if r["low"] >= 0], [r["any"] for r in hits if r["low"] < 0]
    assert sum(personal) / len(personal) > 0.8 and sum(plain) / len(plain) < 0.1


def test_added_spans_leave_base_spans(spark, trees):
    texts = ["call me at (415) 555-0199 or +1 (415) 555-0199 now", "phone 415-555-0199", "order 4155550199123 was sent", "write to joe at example dot com now", "x" * 50_000]
    got = {r["doc_id"]: r for r in pii.find_personal(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), trees).collect()}
    kinds = {k: [s["kind"] for s in r["base"]] + [s["kind"] for s in r["added"]] for k, r in got.items()}
    assert kinds[0] == ["phone", "local_phone"] and kinds[1] == ["local_phone"] and kinds[2] == [] and kinds[3] == ["address_words"] and kinds[4] == []
    for r in got.values():
        spans = sorted((s["start"], s["end"]) for s in [*r["base"], *r["added"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_personal_awkward(spark, trees):
    docs = awkward(spark)
    found = pii.find_personal(docs, trees)
    assert found.count() == docs.count() and not any(r["base"] for r in found.collect())
    assert pii.find_personal(empty(spark), trees).count() == 0


def test_personal_plan_has_no_python(spark, trees):
    plan = pii.find_personal(awkward(spark), trees)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- licenses


def brute_licenses(text, templates, containment=0.8):
    words = licenses.words_of(text or "")
    found = set()
    for name, template in templates.items():
        wanted = licenses.shingle_set(licenses.words_of(template))
        n = len(licenses.words_of(template))
        for k in range(max(1, len(words) - n + 1)):
            if len(wanted & licenses.shingle_set(words[k : k + n])) >= containment * len(wanted):
                found.add(name)
                break
    return found


def with_notices(seed, n=80):
    rng = random.Random(seed)
    names = list(licenses.TEMPLATES)
    rows = []
    for k in range(n):
        filler = lambda m: " ".join(rng.choice(["license", "software", "the", "of", "general", "x", "permission", "copy"]) for _ in range(rng.randrange(m)))
        parts = [filler(60)]
        for name in rng.sample(names, rng.randrange(3)):
            words = licenses.TEMPLATES[name].split()
            if rng.random() < 0.5 and len(words) > 30:
                words[rng.randrange(len(words))] = "changed"
            elif rng.random() < 0.3:
                words = words[: len(words) // 2]
            parts += [" ".join(words).upper() if rng.random() < 0.3 else "\n".join(words), filler(60)]
        rows.append((k, " ".join(parts), "en", "s"))
    return rows


def test_licenses_equal_brute_force(spark):
    rows = with_notices(1)
    got = {}
    for r in licenses.scan_licenses(documents(spark, rows)).collect():
        assert r["containment"] >= 0.8
        got.setdefault(r["doc_id"], set()).add(r["license"])
    for k, text, _, _ in rows:  # a window is longer than its template, so it may hold a little more
        assert brute_licenses(text, licenses.TEMPLATES) <= got.get(k, set())
        for name in got.get(k, set()):
            words, wanted = licenses.words_of(text), licenses.shingle_set(licenses.words_of(licenses.TEMPLATES[name]))
            assert len(wanted & licenses.shingle_set(words)) >= 0.8 * len(wanted)


def test_license_windows_collide_with_the_wanted_probability():
    for shortest, window in licenses.window_classes([len(licenses.words_of(t)) for t in licenses.TEMPLATES.values()]).items():
        assert window.length >= shortest + window.stride - 1 and window.bands < 40


def test_anchors_are_needed_for_containment():
    for template in licenses.TEMPLATES.values():
        words = licenses.words_of(template)
        marks, wanted = licenses.anchors(words), licenses.shingle_set(words)
        assert sum(not marks & set(s.split()) for s in wanted) < 0.8 * len(wanted)


def test_licenses_awkward(spark):
    assert licenses.scan_licenses(awkward(spark)).count() == 0 and licenses.scan_licenses(empty(spark)).count() == 0
    text = licenses.TEMPLATES["MIT (line)"]
    rows = [(None, text, "en", "s"), (1, text, "en", "s"), (1, text, "en", "s"), (2, "filler " * 50_000 + text, "en", "s")]
    got = sorted((r["doc_id"] or 0, r["license"], r["first_word"] > 49_990) for r in licenses.scan_licenses(documents(spark, rows)).collect())
    assert got == [(0, "MIT (line)", False), (1, "MIT (line)", False), (2, "MIT (line)", True)]
    with pytest.raises(ValueError):
        licenses.scan_licenses(empty(spark), {"short": "too few words"})


def test_empty_digest_is_that_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
