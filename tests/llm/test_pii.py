import itertools
from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pii

KEY = b"test"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.sampled_from([26, 30, 256])), min_size=1, max_size=20))
def test_permutation_can_be_undone(parts):
    values, radices = [p[0] for p in parts], [p[1] for p in parts]
    out = pii.permute(values, radices, KEY, "t")
    assert all(0 <= x < r for x, r in zip(out, radices)) and pii.permute(out, radices, KEY, "t", inverse=True) == values


def test_permutation_is_one_to_one_and_keyed():
    every = list(itertools.product(range(10), range(4), range(3)))
    out = [tuple(pii.permute(list(v), [10, 4, 3], KEY, "t")) for v in every]
    assert sorted(out) == every and out != every
    assert out != [tuple(pii.permute(list(v), [10, 4, 3], b"other", "t")) for v in every]


def replaced(text):
    return pii.pseudonymised(text, KEY)


def test_formats_stay_valid():
    card, spans = replaced("pay 4041-8949 ok 4041894974608795 or 4041 8949 7460 8795")
    assert [s[2] for s in spans] == ["card", "card"]
    first, second = card.split("ok ")[1].split(" or ")
    assert first == second.replace(" ", "") != "4041894974608795" and pii.luhn_check([int(c) for c in first[:-1]]) == int(first[-1]) and first[0] == "4"
    iban, spans = replaced("GB82 WEST 1234 5698 7654 32")
    plain = iban.replace(" ", "")
    assert spans[0][2] == "iban" and pii.mod97(plain[4:] + plain[:4]) == 1 and plain.startswith("GB") and len(iban) == 27
    day, spans = replaced("1987-03-21")
    assert spans[0][2] == "date" and date.fromisoformat(day).year // 100 == 19
    other, _ = replaced("21.03.1987")
    assert date.fromisoformat(day) == date(int(other[6:]), int(other[3:5]), int(other[:2]))
    address, spans = replaced("12.245.220.249")
    assert spans[0][2] == "ip" and all(0 <= int(x) < 256 for x in address.split("."))
    phone, spans = replaced("+1 (318) 555-2368")
    assert spans[0][2] == "phone" and phone[:4] == "+1 (" and phone[7:9] == ") " and phone != "+1 (318) 555-2368"
    ssn, spans = replaced("123-45-6789")
    assert spans[0][2] == "ssn" and ssn[3] == ssn[6] == "-"
    mail, spans = replaced("Natpa.55@mail4.example.com")
    assert spans[0][2] == "email" and mail.endswith("@mail4.example.com") and mail[0].isupper() and mail[5] == "." and mail[6:8].isdigit()


def test_clean_texts_stay():
    for text in ("Version 3.0 of 1999, see 12.3.4 and 10.0.0.1", "4328024104680481", "2021-02-30", "000-12-3456", "999.1.1.1", "", "a@b", "1 2 3"):
        assert replaced(text) == (text, [])


def test_values_followed_by_digits_or_capitals():
    for text, kind, value in (
            ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban", "DE89 3704 0044 0532 0130 00"), ("GB82WEST12345698765432 EUR 500", "iban", "GB82WEST12345698765432"),
            ("4111 1111 1111 1111 12/27", "card", "4111 1111 1111 1111"), ("4111111111111111 123", "card", "4111111111111111"),
            ("1234 4111-1111-1111-1111", "card", "4111-1111-1111-1111"), ("3782 822463 10005 11/28", "card", "3782 822463 10005")):
        new, spans = replaced(text)
        assert [(text[s:e], k) for s, e, k in spans] == [(value, kind)], text
        assert len(new) == len(text) and value not in new and new.replace(new[spans[0][0]:spans[0][1]], "") == text.replace(value, "")


def test_phones_without_separators_and_in_pairs():
    for text in ("+14155552671", "+442079460958", "4155552671", "06 12 34 56 78", "+33 6 12 34 56 78", "0470 12 34 56", "+41 44 668 18 00", "+376312345"):
        new, spans = replaced(f"call {text}, or write")
        assert spans == [(5, 5 + len(text), "phone")] and text not in new, text
    assert replaced("+14155552671")[0] == replaced("+1 415 555 2671")[0].replace(" ", "") and replaced("+442079460958")[0].startswith("+44")
    for text in ("1700000000", "01 02 03 04 05 06 07", "0.4155552671", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"):
        assert replaced(text) == (text, [])


def test_equal_values_are_linked_across_documents(messy, docs_of):
    docs = docs_of([(1, "a 4041894974608795 b"), (2, "c 4041894974608795"), (2, None), (None, "12.245.220.249, 12.245.220.249")])
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, KEY).where("text is not null").collect()}
    assert out[1]["text"].split()[1] == out[2]["text"].split()[1]
    a, b = out[None]["text"].split(", ")
    assert a == b and [s["start"] for s in out[None]["private"]] == [0, 16]
    same = pii.pseudonymise(messy, KEY).drop("private")
    assert sorted(map(str, same.collect())) == sorted(map(str, messy.collect())) and pii.pseudonymise(messy.limit(0), KEY).count() == 0
