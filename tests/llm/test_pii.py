import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import ODD, SF, documents as frame
from tidemark.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and sum(
                        sum(map(int, str(2 * int(d)))) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0,
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if keep:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ ()0123456789é\n", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "+1 (988) 555-2485", "10.0.0.255", "300.1.1.1", " ", "x", "@", ".", "1"]), max_size=12))
def test_patterns_side_by_side(parts):
    assert pii.base_spans("".join(parts)) == plain("".join(parts))


def disclosing_corpus():
    rows = []
    for i in range(6):  # the same name near one address, in different words
        rows.append((i, f"alpha{chr(97 + i)} Quenby beta{chr(97 + i)} wrote q.b@mail.example.com the gamma{chr(97 + i)} thing", "a", "en"))
    for i in range(6, 30):
        rows.append((i, f"the thing number {i} that nobody wrote about", "a", "en"))
    return rows


def test_disclosing_terms(spark):
    docs = frame(spark, disclosing_corpus(), extra=True)
    found = pii.find(docs).cache()
    terms = {(r.term, r.action) for r in pii.disclosing_terms(docs, found).collect()}
    assert ("quenby", "removed") in terms and not any(t in ("the", "thing") for t, _ in terms)
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "Quenby" not in out[0].sanitised and "[EMAIL]" in out[0].sanitised
    assert out[20].sanitised == out[20].text
    assert pii.sanitise(docs).columns == [*docs.columns, "sanitised"]


def test_copies_of_a_context_disclose_nothing(spark):
    rows = [(i, "omega Quenby beta wrote q.b@mail.example.com the gamma thing", "a", "en") for i in range(9)]
    rows += [(i, "other words of a text", "a", "en") for i in range(9, 20)]
    docs = frame(spark, rows)
    assert pii.disclosing_terms(docs, pii.find(docs).cache()).count() == 0


def test_far_names_are_found_everywhere(spark):
    filler = lambda i: " ".join(f"the thing that nobody wrote about{'abcdefghij'[i % 10]}" for _ in range(40))
    rows = [(i, f"Quenby {filler(i)} q.b@mail.example.com {filler(i + 1)} Quenby", "a", "en") for i in range(6)]
    rows += [(6, "a note of Quenby without the address", "a", "en")]
    rows += [(i, f"{filler(i)} number {i}", "a", "en") for i in range(7, 60)]
    out = {r.doc_id: r.sanitised for r in pii.sanitise(frame(spark, rows)).collect()}
    assert not any("Quenby" in out[i] for i in range(7)) and out[0].count("nobody") == 80
    assert all(out[i] == t for i, t, *_ in rows[7:])


def test_a_repeated_signature_discloses(spark):
    sign = "regards from Quenby Ostrava chief of all things q.b@mail.example.com call any time on any day of week"
    rows = [(i, f"letter number{chr(97 + i)} about things. {sign}", "a", "en") for i in range(6)]
    rows += [(i, "a letter about things from all of them on any day, call any time, regards, chief of week", "a", "en") for i in range(6, 60)]
    docs = frame(spark, rows)
    terms = {r.term for r in pii.disclosing_terms(docs, pii.find(docs).cache()).collect()}
    assert terms == {"quenby", "ostrava"}


def test_query_on_all_documents(spark):
    rows = queries.op3_pii_disclosure(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in want) for kind in PATTERNS)
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows_and_empty_table(spark):
    assert pii.sanitise(frame(spark, ODD, extra=True)).count() == len(ODD)
    assert pii.sanitise(frame(spark, [])).count() == 0
