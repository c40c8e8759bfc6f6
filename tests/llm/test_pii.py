import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import pii

KEY = b"a key for tests..."
NAMES = pii.Names([("Mara", "Grimanard"), ("Javier", "Galsaby"), (None, None), ("", " ")])


@given(st.integers(1, 10**12), st.data())
@settings(max_examples=60, deadline=None)
def test_feistel_is_a_permutation(size, data):
    v = data.draw(st.integers(0, size - 1))
    w = pii.feistel(v, size, b"k", "t")
    assert 0 <= w < size and pii.unfeistel(w, size, b"k", "t") == v


def test_feistel_covers_small_ranges():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(pii.feistel(v, size, KEY) for v in range(size)) == list(range(size))


def test_formats_are_kept():
    card = pii.permute_card("4111-1111 1111 1111", KEY)
    assert card[4] == "-" and card[9] == " " and pii.luhn("".join(filter(str.isdigit, card))) and card == pii.permute_card("4111-1111 1111 1111", KEY)
    iban = pii.permute_iban("GB82 WEST 1234 5698 7654 32", KEY)
    assert iban.startswith("GB") and "WEST" in iban and pii.mod97(iban.replace(" ", "")) == 1 and len(iban) == 27
    assert pii.permute_date("2024-02-29", KEY)[4] == "-" and pii.permute_date("31.12.1999", KEY)[2] == "." and pii.permute_date("99.99.1999", KEY) == "99.99.1999"
    assert pii.permute_phone("+44 1632 960 439", KEY).startswith("+44 ")


def digits(text):
    return "".join(c for c in text if c.isdecimal())


@pytest.mark.parametrize("value", ["+34 91 123 45 67", "+49 30 123 45 67", "0033 199 00 80 78", "+33 199 00 80 78", "+33 1 99 00 80 78", "+49 (0)30 23125-571", "+1 (555) 555-0113", "+44 1632 960 439", "(555) 555-0113", "06 99 00 80 78", "030/23125-203", "900 000 768", "+351 21 123 45 67"])
def test_whole_numbers_are_masked(value):
    for before, after in (("ring ", " today"), ("", ""), ("ring ", " 3 times"), ("a\n", "\nb")):
        text = pii.mask(before + value + after, NAMES, KEY)
        start, _, end = text.partition("[PHONE ")
        inside, _, end = end.partition("]")
        assert start == before and end == after and digits(inside) != digits(value) and len(inside) == len(value), text


def test_one_number_has_one_pseudonym():
    a, b, c = (pii.permute_phone(v, KEY) for v in ("+33 1 99 00 80 78", "0033 199 00 80 78", "+33 (0)199008078"))
    assert digits(a)[2:] == digits(b)[4:] == digits(c)[3:] and a.startswith("+33 ") and b.startswith("0033 ") and c.startswith("+33 (0)")


def test_check_signs_are_right_again():
    for value in ("07593980-R", "12345678Z", "X1234567L"):
        new = pii.permute_idnum(value, KEY)
        number = digits(new) if new[0] != "X" else "0" + digits(new)
        assert pii._DNI_LETTERS[int(number) % 23] == new[-1] and len(new) == len(value) and new != value
    nir = digits(pii.permute_idnum("2 17 00 99 292 538 67", KEY))
    assert int(nir[13:]) == 97 - int(nir[:13]) % 97
    tin = digits(pii.permute_idnum("03 040 210 682", KEY))
    assert tin[-1] == pii._mod11_10(tin[:-1])


def test_a_key_is_needed(spark):
    some = spark.createDataFrame([], "query_id bigint, query string"), spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame([], "given_name string, family_name string")
    for key in (b"", None, b"short"):
        with pytest.raises(ValueError, match="key"):
            pii.masked(*some, key)


def test_a_large_directory_gives_the_same(spark, monkeypatch):
    requests = spark.createDataFrame([(1, "ask Mara Grimanard"), (2, "GALSABY, Javier"), (3, "javier galsaby"), (4, None), (5, "the Grimanard valve"), (6, "K. Galsaby")], "query_id bigint, query string")
    chunks = spark.createDataFrame([(7, "ask Mara Grimanard"), (7, "ask Mara Grimanard")], "id bigint, text string")
    staff = spark.createDataFrame([("Mara", "Grimanard"), ("Javier", "Galsaby"), (None, None), (" ", "")], "given_name string, family_name string")
    small = [sorted(map(str, f.collect())) for f in (pii.found(requests, chunks, staff), pii.masked(requests, chunks, staff, KEY))]
    monkeypatch.setattr(pii, "KNOWN_PEOPLE", 1)
    assert small == [sorted(map(str, f.collect())) for f in (pii.found(requests, chunks, staff), pii.masked(requests, chunks, staff, KEY))]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to mara.grim@mail.example.", {"email"}),
        ("mara.grim [at] mail [dot] example", {"email"}),
        ("a AT b DOT test", {"email"}),
        ("Write '@' before the desk code, e.g. @MH-3522.", set()),
        ("ring (555) 555-0113 or +49 (0)30 23125-571, 030/23125-203, 0033 199 00 80 78, 900 000 768", {"phone"}),
        ("Order no. 9305220801 replaces order no. 4640266560.", set()),
        ("Part no. 849-54-6055 fits, Batch 3218 9164 6056 7344, Version 91.27.93", set()),
        ("SSN 974-41-4042", {"idnum"}),
        ("my ssn is 912197728", {"idnum"}),
        ("Steuer-ID 03 040 210 682", {"idnum"}),
        ("Numéro de sécurité sociale 2 17 00 99 292 538 67", {"idnum"}),
        ("passport no. X23J77585", {"idnum"}),
        ("DNI 07593980-R", {"idnum"}),
        ("IBAN GB82WEST12345698765432", {"iban"}),
        ("IBAN GB82WEST12345698765433", set()),
        ("card 4111 1111 1111 1111 twice", {"card"}),
        ("card 4111 1111 1111 1112 twice", set()),
        ("96 Stavzestad Street, Apt 7", {"address"}),
        ("bei Selvivanegasse 48b, D-00315 Holsby", {"address"}),
        ("demeurant 65 bis, place Wensarath, 00228 Raszell", {"address"}),
        ("en C/ Torlofort 50, bajo", {"address"}),
        ("Dear Mara Lumvinett, hello", {"name"}),
        ("GRIMANARD, Mara and Mrs. Unknown", {"name"}),
        ("Did Mara Grimanard see K. Indmufeld?", {"name"}),
        ("The Grimanard building has 2 rooms; the Grimanard valve", set()),
        ("at no more than 2 °C. The tenant", set()),
        ("[EMAIL] [NAME] [PHONE]", set()),
        ("", set()),
    ],
)
def test_found(text, kinds):
    assert {k for _, _, k in pii.find(text, NAMES)} == kinds


def test_tables(spark):
    requests = spark.createDataFrame([(1, "ring 555-555-0109"), (1, "ring 555-555-0109"), (2, None), (None, "a@b.org"), (3, "")], "query_id bigint, query string")
    chunks = spark.createDataFrame([(7, "Mara Grimanard, card 4111 1111 1111 1111"), (8, "x" * 100_000)], "id bigint, text string")
    staff = spark.createDataFrame([("Mara", "Grimanard")], "given_name string, family_name string")
    assert sorted(map(tuple, pii.found(requests, chunks, staff).collect())) == [("chunk", 7, "card"), ("chunk", 7, "name"), ("request", 1, "phone")]
    rows = {(r.origin, r.rec_id): r.text for r in pii.masked(requests, chunks, staff, KEY).collect()}
    assert rows["chunk", 7].startswith("[NAME], card [CARD ") and rows["request", 2] is None and len(rows["chunk", 8]) == 100_000
    again = pii.mask(rows["request", 1], NAMES, KEY)
    assert "[PHONE" in again
    assert pii.found(requests.where("false"), chunks.where("false"), staff.where("false")).count() == 0


def test_equal_values_stay_linked():
    rng = random.Random(0)
    seen = {f"555-555-{rng.randint(0, 9999):04d}" for _ in range(200)}
    assert len({pii.placeholder("phone", v, KEY) for v in seen}) == len(seen)
