"""PII pseudonyms: validity, linkage, permutation, and clean texts left alone."""

import ipaddress
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexspark.llm import pii


IBANS = [
    "GB82WEST12345698765432", "NL91ABNA0417164300", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "IE29AIBK93115212345678",
    "MT84MALT011000012345MTLCAST001S", "NO9386011117947", "DE89370400440532013000", "AT611904300234573201",
]


def grouped(iban):
    return " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))


STAY = ["999.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "12:30", "v1.2.3", "8669794464398878", "a-b", "", None, "DE00370400440532013000"]
CARDS = ["pay 4111111111111111 now", "4111 1111 1111 1111", "4111111111111112"]
KINDS = ["ip 161.17.88.162.", "on 2024-02-29", "123-45-6789", "DE89370400440532013000", "x ann.b@mail.org", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "+1 (017) 555-7713"]
EMAILS = ["a" * 80 + "@example.com", "jörg.müller@example.com", "иван@почта.example", "x" * 100_000 + " no address", "@", "a@b"]
YEARS = ["12/05/1799", "1066-10-14", "31.12.9999", "0000-01-01", "2023-02-29"]
PHONES = ["+33 1 23 45 67 89", "+61 2 9876 5432", "+49 30 123456-7"]
PAIRS = ["first 4111111111111111", "and 4111111111111111 again", "DE36370400440532013013", "GB83WEST12345698765432"]
EVERY = [*STAY, *CARDS, *KINDS, *EMAILS, *YEARS, *PHONES, *PAIRS, *(t for i in IBANS for t in (f"to {i}.", f"to {grouped(i)} EUR"))]


_known: dict = {}


def swap(spark, *texts, key="k"):
    """The texts with pseudonyms. All texts of this module go through one plan, as planning takes most of the time."""
    if key not in _known or not set(texts) <= set(_known[key]):
        every = [*dict.fromkeys([*texts, *(EVERY if key == "k" else ())])]
        rows = spark.createDataFrame([*enumerate(every)], "doc_id long, text string").withColumn("n_private", F.lit("clash"))
        _known.setdefault(key, {}).update(zip(every, [r.text for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]))
    return [_known[key][t] for t in texts]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_cards(spark):
    plain, spaced, bad = swap(spark, *CARDS)
    new = re.search(r"\d{16}", plain)[0]
    assert new != "4111111111111111" and luhn(new) and spaced.replace(" ", "") == new and re.fullmatch(r"(\d{4} ){3}\d{4}", spaced)
    assert bad == "4111111111111112"


def test_invalid_values_stay(spark):
    assert swap(spark, *STAY) == STAY


def test_other_kinds(spark):
    ip, day, ssn, iban, mail, secret, phone = swap(spark, *KINDS)
    assert ipaddress.ip_address(ip[3:-1]) and "161.17" not in ip
    assert date.fromisoformat(day[3:]) and day != "on 2024-02-29"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "123-45-6789"
    moved = iban[4:] + "1314" + iban[2:4]
    assert int(moved) % 97 == 1 and iban != "DE89370400440532013000"
    assert "ann" not in mail and mail.endswith("@mail.org")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', secret) and "9b0b3c" not in secret
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and "555-7713" not in phone


def test_linked_and_keyed(spark):
    a, b = swap(spark, "first 4111111111111111", "and 4111111111111111 again")
    assert re.search(r"\d{16}", a)[0] == re.search(r"\d{16}", b)[0]
    assert swap(spark, "first 4111111111111111", key="other") != [a]


@pytest.mark.parametrize("left, right", [(27, 41), (16, 16), (1, 7)])
def test_feistel_permutes(spark, left, right):
    n = left * right
    got = spark.range(n).select(pii.feistel(F.col("id"), F.lit(left), F.lit(right), F.lit("key"), "t").alias("x")).collect()
    assert sorted(r.x for r in got) == [*range(n)]


def test_counts_and_rows(spark):
    rows = spark.createDataFrame([(1, "4111111111111111 1.2.3.4"), (1, "4111111111111111 1.2.3.4"), (2, "x " * 50_000), (3, None)], "doc_id long, text string")
    got = pii.pseudonymise(rows, "k").orderBy("doc_id").collect()
    assert [r.n_private for r in got] == [2, 2, 0, 0] and got[2].text == "x " * 50_000 and got[3].text is None
    assert pii.pseudonymise(rows.limit(0), "k").count() == 0


def test_plan_is_native(spark, data):
    plan = pii.op7_pii(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_leaves_clean_texts(spark, data):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, data).collect():
        assert (r.text == before[r.doc_id]) == (r.n_private == 0)
        for value in re.findall(r"(?<![\w.-])\d{16}(?![\w-])", before[r.doc_id]):
            assert (value in r.text) != luhn(value)


def test_ibans_with_letters_and_short_ones(spark):
    texts = [t for i in IBANS for t in (f"to {i}.", f"to {grouped(i)} EUR")]
    got = swap(spark, *texts)
    for iban, plain, spaced in zip(IBANS, got[::2], got[1::2]):
        new = plain[3:-1]
        assert spaced == f"to {grouped(new)} EUR" and new[4:] != iban[4:] and new[:2] == iban[:2]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in iban]
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    assert swap(spark, "GB83WEST12345698765432") == ["GB83WEST12345698765432"]


def test_phones_with_groups_of_one_digit(spark):
    for old, new in zip(PHONES, swap(spark, *PHONES)):
        assert new != old and new[:3] == old[:3] and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)


def permuted(spark, values, use, key="k"):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.new for r in rows.select("v", use(F.col("v"), F.lit(key)).alias("new")).collect()}
    assert len(got) == len(set(values)) == len(set(got.values())), "two values got one pseudonym"
    return got


def slashes(year):
    """All slash dates of a year that can be read: day first, or month first."""
    out = set()
    for i in range(366):
        n = date(year, 1, 1).toordinal() + i
        if n <= date(year, 12, 31).toordinal():
            d = date.fromordinal(n)
            out |= {f"{d.day:02d}/{d.month:02d}/{year:04d}", f"{d.month:02d}/{d.day:02d}/{year:04d}"}
    return sorted(out)


def test_slash_dates_keep_apart(spark):
    years = [1, 2, 197, 198, 1797, 1798, 1799, 2023, 2024, 2197, 2198, 9797, 9798, 9999]
    got = permuted(spark, [x for y in years for x in slashes(y)], pii._date)
    for old, new in got.items():
        a, b, y = map(int, new.split("/"))
        date(y, b, a) if b <= 12 else date(y, a, b)
        assert (int(old[3:5]) > 12) == (b > 12)
    assert sum(old == new for old, new in got.items()) < 5


def test_whole_eras_are_permuted(spark):
    """All late days of the shortest era, and all days of it."""
    every = [date.fromordinal(n) for n in range(1, date(197, 12, 31).toordinal() + 1)]
    got = permuted(spark, [d.isoformat() for d in every], pii._date)
    assert set(got.values()) == set(got)
    late = [f"{d.month:02d}/{d.day:02d}/{d.year:04d}" for d in every if d.day > 12]
    got = permuted(spark, late, pii._date)
    assert set(got.values()) == set(late)


def test_no_pseudonym_twice(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def with_luhn(body):
        return next(body + c for c in "0123456789" if luhn(body + c))

    def with_check(country, account):
        n = int("".join(str(int(c, 36)) for c in account + country + "00"))
        return f"{country}{98 - n % 97:02d}{account}"

    cards = {with_luhn(digits(15)) for _ in range(2000)}
    ibans = {with_check("DE", digits(18)) for _ in range(1000)} | {with_check("GB", "".join(rng.choices("ABCDEFGH", k=4)) + digits(14)) for _ in range(1000)}
    ibans |= {with_check("MT", "".join(rng.choices("ABC", k=4)) + digits(5) + "".join(rng.choices("AB1", k=18))) for _ in range(200)}
    phones = {f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" for _ in range(2000)}
    ssns = {f"{a:03d}-{g:02d}-{rng.randrange(1, 10000):04d}" for a in (1, 2, 665, 667, 899) for g in range(1, 100)}
    ips = {".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(2000)}
    for values, use in ((cards, pii._card), (ibans, pii._iban), (phones, pii._phone), (ssns, pii._ssn), (ips, pii._ip)):
        permuted(spark, sorted(values), use)


def test_equal_parts_of_an_iban_do_not_show(spark):
    a, b = swap(spark, "DE89370400440532013000", "DE36370400440532013013")
    assert a[4:13] != b[4:13]
    assert a[4:13] != a[13:22]


def test_email_names_of_any_length_and_script(spark):
    texts, got = EMAILS, swap(spark, *EMAILS)
    for old, new in zip(texts[:3], got):
        assert new.endswith(old[old.index("@") :]) and not re.search("aaaaaaaa|jörg|müller|иван", new)
    assert got[3:] == texts[3:]


def test_all_years(spark):
    for text, new in zip(YEARS, swap(spark, *YEARS)):
        assert (new == text) == (text in ("0000-01-01", "2023-02-29"))


def test_planted_values_are_gone(spark, data):
    """Every value that a brute-force search of the given texts validates is missing from the output at its place."""
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, data).collect():
        text = before[r.doc_id]
        found = [m for m in re.findall(r"(?<![\w.-])\d{13,19}(?![\w-])", text) if luhn(m)]
        found += re.findall(r"[\w.+-]+@[\w-]+\.[\w.]*\w", text) + re.findall(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w.])", text)
        assert not [m for m in found if m in r.text]


def test_the_stage_takes_its_key_from_the_session(spark):
    docs = spark.createDataFrame([(1, "on 2024-02-29", None, "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    run = lambda: pii.pii_stage(spark, docs, "").first().text
    spark.conf.set(pii.KEY_SETTING, "one")
    first = run()
    assert first == run() and first != swap(spark, "on 2024-02-29", key=pii.EXAMPLE_KEY)[0]
    spark.conf.unset(pii.KEY_SETTING)
    assert len({run() for _ in range(3)}) == 1  # one key for the application, so two runs give equal rows
    made = set()
    for _ in range(3):
        pii._made.clear()
        made.add(run())
    assert len(made) > 1  # another application has another key


def test_secrets_of_any_length(spark):
    texts = ["a" * 32, "0123456789abcdef" * 8, "AbCdEf0123" * 4, "ABCDEF0123456789" * 5, "f" * 1000, "a" * 31]
    got = swap(spark, *texts)
    for old, new in zip(texts[:-1], got):
        assert len(new) == len(old) and new != old and re.fullmatch("[0-9a-f]+|[0-9A-F]+", new)
    assert len({new[i : i + 64] for new in got[4:5] for i in range(0, 960, 64)}) == 15  # no digest repeats
    assert got[-1] == texts[-1] and swap(spark, *texts) == got
