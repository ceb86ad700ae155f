"""Checks of candidate values, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IBAN lengths by country.
IBAN_LENGTHS = {"DE": 22, "GB": 22, "FR": 27, "NL": 18}


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[ \-]", "")
    return digits.rlike(r"^[0-9]{13,19}\z") & F.call_function("luhn_check", digits)


def iban(value: Column) -> Column:
    """Known length for the country and remainder 1 by 97 of the rearranged number."""
    v = F.upper(F.regexp_replace(value, r"\s+", ""))
    length = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])[F.substring(v, 1, 2)]
    moved = F.concat(F.substr(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))

    def step(rest, c):
        number = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return ((rest * F.when(number < 10, 10).otherwise(100) + number) % 97).cast("int")

    return F.coalesce((F.length(v) == length) & v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+\z"), F.lit(False)) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def domain_labels(domain: Column) -> Column:
    """Two labels or more, a TLD of 2 to 63 letters, no label empty, over 63 bytes or with a hyphen at an edge."""
    labels = F.split(domain, r"\.", -1)
    good = F.forall(labels, lambda x: (x != "") & (F.octet_length(x) <= 63) & ~x.startswith("-") & ~x.endswith("-"))
    return (F.size(labels) >= 2) & F.element_at(labels, -1).rlike(r"^[A-Za-z]{2,63}\z") & good


def email(value: Column) -> Column:
    return (F.split_part(value, F.lit("@"), F.lit(1)) != "") & domain_labels(F.regexp_extract(value, r"^[^@]*@(.*)\z", 1))


def url(value: Column) -> Column:
    return domain_labels(F.regexp_extract(value, r"^https?://([A-Za-z0-9.-]+)", 1))


def us_ssn(value: Column) -> Column:
    area = F.substring(value, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")


def ip_address(value: Column) -> Column:
    """Four octets to 255 (one with leading zeros must be octal), or an IPv6 address with one ``::`` at most."""
    octet = lambda o: F.when(o.rlike(r"^0[0-9]+\z"), o.rlike(r"^0[0-7]+\z") & (F.conv(o, 8, 10).cast("int") <= 255)).otherwise(o.cast("int") <= 255)
    four = value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z") & F.forall(F.split(value, r"\."), octet)
    hexes = "[0-9A-Fa-f]{1,4}"
    full = value.rlike(rf"^({hexes}:){{7}}{hexes}\z")
    short = value.rlike(rf"^({hexes}(:{hexes})*)?::({hexes}(:{hexes})*)?\z") & (F.size(F.regexp_extract_all(value, F.lit(f"{hexes}"), F.lit(0))) <= 7)
    return four | full | short


def phone_digits(value: Column) -> Column:
    """Digits before an extension, without the country prefix."""
    digits = F.regexp_replace(F.element_at(F.split(value, "[xX]", 2), 1), "[^0-9]", "")
    n = F.length(digits)
    return F.when((n == 13) & digits.startswith("001"), F.substring(digits, 4, 10)).when((n == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def phone(value: Column) -> Column:
    """No date, at least 7 digits, no repeated or counting digits; 8, 9, 10 or 12 digits, area and exchange not 000."""
    d = phone_digits(value)
    junk = (F.length(d) < 7) | d.rlike(r"^([0-9])\1*\z") | d.isin("12345678", "123456789", "1234567890", "98765432", "987654321", "9876543210")
    date = F.trim(value).rlike(r"^(?:[0-9]{4}[-. /][0-9]{1,2}[-. /][0-9]{1,2}|[0-9]{1,2}[-. /][0-9]{1,2}[-. /][0-9]{2,4})\z")
    return ~junk & ~date & F.length(d).isin(8, 9, 10, 12) & (F.substring(d, 1, 3) != "000") & (F.substring(d, 4, 3) != "000")
