import hashlib
import re
import zlib

from samples import ODD, table

from hazardlake.llm import language, pii

SAMPLES = {
    "en": "the house is on the hill and they went there with their friends to see what was happening",
    "de": "das haus steht auf dem berg und sie gingen dort mit ihren freunden hin um zu sehen was geschieht",
    "fr": "la maison est sur la colline et ils sont partis avec leurs amis pour voir ce qui se passait",
}


def varied(text, k):
    w = text.split()
    return " ".join(w[(i * 7 + k) % len(w)] for i in range(4 + k % 40))


def test_held_out_accuracy_and_odd_rows(spark):
    rows, langs = [], []
    for k in range(300):
        lang = sorted(SAMPLES)[k % 3]
        rows.append((1000 + k, varied(SAMPLES[lang], k)))
        langs.append(lang)
    docs = table(spark, rows + ODD, langs + [None] * len(ODD))
    got = language.identify(docs).collect()
    assert len(got) == len(rows) + len(ODD)
    truth = {r[0]: x for r, x in zip(rows, langs)}
    tested = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(tested) > 30
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {3, 4, 5, 15}


def test_held_out_labels_do_not_matter(spark):
    rows = [(k, varied(SAMPLES["en" if k % 2 else "de"], k)) for k in range(80)]
    langs = ["en" if k % 2 else "de" for k in range(80)]
    other = ["fr" if zlib.crc32(str(k).encode()) % 5 == 0 else x for k, x in enumerate(langs)]
    a, b = (sorted(language.identify(table(spark, rows, x)).collect()) for x in (langs, other))
    assert a == b


def test_without_labels_or_rows(spark):
    unlabelled = table(spark, ODD, [None] * len(ODD))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    # nothing to learn from: texts with letters stay
    assert language.keep_identified(unlabelled).exceptAll(unlabelled).isEmpty()
    assert {r.doc_id for r in unlabelled.exceptAll(language.keep_identified(unlabelled)).collect()} == {3, 4, 5, 15}
    assert language.identify(table(spark).limit(0)).count() == 0
    docs = table(spark)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in ODD} - {3, 4, 5, 15}


PRIVATE = [
    "mail a.b+c@x-y.example.org, or a@b or @c.d or x@y.z@w.v.u.",
    "1.2.3.4.5 and 256.1.1.1 and 001.002.003.004 and 9.9.9",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 12345678901234567890123",
    "+1 (499) 555-6503 and +49 30 123 and +1234567890 +12345678901234567",
    "é日本 +1 (312) 555-0142\n+1 (312) 555-0142 10.0.0.1",
    "call (212) 555-0199, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
    "version 2.0 of 1998, 45 % of 3,500",
    "",
    None,
    "7" * 5000 + " @" * 2000 + " 1.1" * 3000,
]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_base_spans_and_additions(spark):
    rows = {r.doc_id: r for r in pii.find_personal_data(table(spark, list(enumerate(PRIVATE)))).collect()}
    assert len(rows) == len(PRIVATE)
    for i, text in enumerate(PRIVATE):
        want = base(text or "")
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in pii.BASE_KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(spans)
    assert "phone:5:19" in rows[5].spans and "secret:30:70" in rows[5].spans
    assert rows[6].spans == ""


def test_field_learns_its_table_and_leaves_prose_alone(spark):
    field = pii.train()
    right = total = 0
    for row, (x, open_, gold) in zip(pii.LABELLED, pii.labelled_sequences(pii.LABELLED)):
        got = pii.viterbi(field, *pii.padded([x], [open_]))[0]
        right += (got == gold).sum()
        total += len(gold)
    assert right / total > 0.99
    prose = ["In 1871 some 1,200 men marched 30 km.", "Tables 3.1 and 4.2 list 17 items from 2003."]
    assert pii.field_spans(field, prose) == [[], []]
    unseen = "please phone (415) 555-2671 or write to tom@mail.example.org"
    assert {(k, unseen[a:b]) for k, a, b in pii.field_spans(field, [unseen])[0]} == {("phone", "(415) 555-2671"), ("email", "tom@mail.example.org")}


def test_no_documents(spark):
    assert pii.find_personal_data(table(spark).limit(0)).count() == 0


def test_patterns_of_addresses_are_linear_and_equal():
    import random
    import re
    import time

    contract = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice("1234..  .x٣") for _ in range(draw.randrange(40)))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in contract.finditer(text)]
    began = time.time()
    assert not list(pii.IP.finditer("7" * 1_000_000)) and len(list(pii.IP.finditer("1." * 500_000))) == 125_000
    assert time.time() - began < 5
