import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from twinweave.llm import pii

KEY = "k"


def digest(kind, *parts):
    return hashlib.sha256("|".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()


def brute_permuted(value, kind):
    """The character network in plain Python."""

    def moved(half, other, round_):
        out = []
        for i, c in enumerate(half):
            by = int(digest(kind, round_, i // 16, len(half), other)[i % 16 * 4 : i % 16 * 4 + 4], 16)
            for first, size in pii._CLASSES:
                if first <= ord(c) < first + size:
                    c = chr((ord(c) - first + by) % size + first)
                    break
            out.append(c)
        return "".join(out)

    cut = -(-len(value) // 2)
    a, b = value[:cut], value[cut:]
    for r in range(pii.ROUNDS):
        a, b = (moved(a, b, r), b) if r % 2 == 0 else (a, moved(b, a, r))
    return a + b


def brute_pair(a, b, sizes, kind):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + int(digest(kind, r, b)[:12], 16)) % sizes[0]
        else:
            b = (b + int(digest(kind, r, a)[:12], 16)) % sizes[1]
    return a, b


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def replaced(docs, *texts):
    rows = pii.pseudonymized(docs(list(enumerate(texts))), KEY).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n_pseudonyms for r in rows]


def test_cards(docs):
    plain, spaced, bad = "4111111111111111", "4111 1111 1111 1111", "4111111111111112"
    (a, b, c), n = replaced(docs, f"pay {plain}.", f"pay {spaced}!", f"no {bad}")
    new = re.search(r"\d{16}", a)[0]
    payload = brute_permuted(plain[:15], "card")
    assert new[:15] == payload and luhn(new) and new != plain
    assert b == f"pay {' '.join(new[k : k + 4] for k in range(0, 16, 4))}!"
    assert c == f"no {bad}" and n == [1, 1, 0]


def test_dates(docs):
    day = datetime.date(1984, 2, 29)
    forms = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y"]
    texts, n = replaced(docs, *[f"born {day.strftime(f)}, ok" for f in forms], "born 29 February 1984", "born February 29, 1984", "on 2023-02-30")
    place = (day - datetime.date(1800, 1, 1)).days
    a, b = brute_pair(place // 773, place % 773, (189, 773), "date")
    new = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
    assert texts[:4] == [f"born {new.strftime(f)}, ok" for f in forms]
    assert texts[4] == f"born {new.day} {new.strftime('%B %Y')}" and texts[5] == f"born {new.strftime('%B')} {new.day}, {new.year}"
    assert texts[6] == "on 2023-02-30" and n == [1] * 6 + [0]


def test_addresses_and_numbers(docs):
    texts, _ = replaced(docs, "at 192.168.10.7.", "at 127.0.0.1", "ssn 219-09-9999", "ssn 000-12-3456", "tel +1 (017) 555-7713",
                        "tel (017) 555-7713", "tel +49 30 1234567", "iban GB82 WEST 1234 5698 7654 32", "iban GB00 WEST 1234 5698 7654 32")
    a, b = brute_pair(192 * 256 + 168, 10 * 256 + 7, (65536, 65536), "address")
    assert texts[0] == f"at {a // 256}.{a % 256}.{b // 256}.{b % 256}." and texts[1] == "at 127.0.0.1"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", texts[2]) and texts[2] != "ssn 219-09-9999" and texts[3] == "ssn 000-12-3456"
    national = brute_permuted("0175557713", "telephone")
    assert texts[4] == f"tel +1 ({national[:3]}) {national[3:6]}-{national[6:]}" and texts[5] == f"tel ({national[:3]}) {national[3:6]}-{national[6:]}"
    assert texts[6].startswith("tel +49 ") and texts[6] != "tel +49 30 1234567"
    iban = texts[7][5:].replace(" ", "")
    number = int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))
    assert number % 97 == 1 and iban[:2] == "GB" and iban[4:] == brute_permuted("WEST12345698765432", "iban") and texts[8].endswith("7654 32")


def test_mail_and_secrets(docs):
    (a, b, c, d), n = replaced(docs, "to jane.doé55@mail1.example.com!", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "a@b", "hash 04dbebab91ab85687d33eeaaf9ac699e1188f962")
    assert a == f"to {brute_permuted('jane.doé55', 'mail')}@mail1.example.com!"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', b) and "04dbebab" not in b and (c, d) == ("a@b", "hash 04dbebab91ab85687d33eeaaf9ac699e1188f962")
    assert n == [1, 1, 0, 0]


def test_cards_and_ibans_among_other_groups(docs):
    card = "4111 1111 1111 1111"
    texts, n = replaced(docs, card, f"{card} 12/25", f"{card} 123", f"7 {card}", f"{card} 4242 4242 4242 4242 99", "4111111111111111123", "1234 5678 9012 3456 7890 1234 5678")
    new = texts[0]
    assert texts[1:4] == [f"{new} 12/25", f"{new} 123", f"7 {new}"]
    assert texts[4].startswith(new) and texts[4].endswith(" 99") and luhn(texts[4][20:39].replace(" ", "")) and "4242 4242" not in texts[4]
    assert texts[5:] == ["4111111111111111123", "1234 5678 9012 3456 7890 1234 5678"] and n == [1] * 5 + [0, 0]
    iban = "AT61 1904 3002 3457 3201"
    texts, n = replaced(docs, iban, f"{iban} SENT", f"{iban} INTERNATIONALIZATION", f"{iban} DE89 3704 0044 0532 0130 00", iban.replace(" ", "") + "X")
    assert texts[1:3] == [f"{texts[0]} SENT", f"{texts[0]} INTERNATIONALIZATION"] and texts[0] != iban
    assert texts[3].startswith(f"{texts[0]} DE") and "3704 0044" not in texts[3] and n == [1, 1, 1, 2, 0]


def test_long_runs_of_numbers(docs):
    run = " ".join(str(k % 90 + 10) for k in range(5000))
    (a, b, c), n = replaced(docs, run, "1" * 50_000, f"{run} 4111 1111 1111 1111")
    assert a == run and b == "1" * 50_000 and c.startswith(run) and n == [0, 0, 1]


def test_dates_with_names_in_four_languages(docs):
    texts, n = replaced(docs, "29 February 1984", "29. Februar 1984", "29 février 1984", "29 de febrero de 1984", "Feb 29, 1984", "1984-2-29", "31 June 2001")
    day, year = re.match(r"(\d+) ", texts[0])[1], texts[0][-4:]
    at = pii._NAMES.index(texts[0].split()[1])
    assert texts[1] == f"{day}. {pii._NAMES[at + 24]} {year}" and texts[2] == f"{day} {pii._NAMES[at + 36]} {year}"
    assert texts[3] == f"{day} de {pii._NAMES[at + 48]} de {year}" and texts[4] == f"{pii._NAMES[at + 12]} {day}, {year}"
    assert texts[5] == f"{year}-{at + 1}-{day}" and texts[6] == "31 June 2001" and n == [1] * 6 + [0]


def test_mail_after_punctuation_and_long_secrets(docs):
    texts, n = replaced(docs, "-jane@x.com", "_bob@y.org", 'key = "' + "ab12" * 40 + '"')
    assert texts[0] != "-jane@x.com" and texts[1] != "_bob@y.org" and "ab12ab12" not in texts[2] and n == [1, 1, 1]


def test_the_key_is_the_session_s(spark):
    made = pii.key_of(spark)
    assert made == pii.key_of(spark) and len(made) == 64
    spark.conf.set(pii.KEY_SETTING, "own")
    assert pii.key_of(spark) == "own"
    spark.conf.unset(pii.KEY_SETTING)


def test_columns_with_the_operator_s_names_stay(spark):
    names = ["_found", "_New", "__found", "gaps"]
    rows = spark.createDataFrame([("1.2.3.4", *names)], ", ".join(f"{c} string" for c in ["text", *names]))
    (row,) = pii.pseudonymized(rows, KEY).collect()
    assert list(row)[1:5] == names and row.n_pseudonyms == 1


def test_permutation_has_no_collisions(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert rows.select(pii.permuted(F.col("v"), KEY, "t").alias("p")).distinct().count() == 1000
    pair = pii.permuted_pair(F.floor(F.col("id") / 9), F.col("id") % 9, (21, 9), KEY, "t")
    assert spark.range(189).select(pair.alias("p")).distinct().count() == 189


def test_odd_rows(odd, docs):
    rows = pii.pseudonymized(odd, KEY).select("doc_id", "text", "n_pseudonyms", "found").collect()
    assert len(rows) == 6 and all(r.n_pseudonyms == 0 and r.found == "clash" for r in rows)
    assert pii.pseudonymized(docs([]), KEY).count() == 0


@pytest.mark.parametrize("text", ["4111111111111111 4111111111111111", "1.2.3.4\n1.2.3.4"])
def test_equal_values_stay_linked(docs, text):
    ((new,), (n,)) = replaced(docs, text)
    assert n == 2 and len(set(new.split())) == 1


def test_query_changes_no_text_without_digits_or_at(spark, sf):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    after = pii.query(spark, sf).collect()
    assert len(after) == len(before)
    for r in after:
        if r.n_pseudonyms == 0:
            assert r.text == before[r.doc_id]
        else:
            assert r.text != before[r.doc_id]
            assert re.sub(r"[\w.]", "", r.text) == re.sub(r"[\w.]", "", before[r.doc_id])
