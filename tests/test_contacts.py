"""Contacts that are masked, and figures that are left alone."""

import pytest
from pyspark.sql import functions as F

from loomline.functions.contacts import EMAIL as E
from loomline.functions.contacts import PHONE as P
from loomline.functions.contacts import masked

CASES = [
    ("write to ann.b@mail-firm.com.", f"write to {E}."), ("ann @ firm.org now", f"{E} now"), ("ann[at]firm.org", E), ("ann (at) firm.com", E), ("<mailto:a@firm.org>", f"<mailto:{E}>"), ("ANN@FIRM.ORG", E),
    ("Tel.: (31) 3477-8100", f"Tel.: {P}"), ("(031) 3477-8100", P), ("(0xx31) 3477-8100/8200", P), ("+55 (21) 3477-0000 ramal 12", P), ("(11) 98877-6655", P),
    ("55 31 3477.8100", P), ("+55 11 98877-6655", P), ("+5511988776655", P), ("55-11-3477-9330", P),
    ("+1 (212) 555-0187 x", f"{P} x"), ("+44 20 7946 0958", P),
    ("call 0800 722 1100", f"call {P}"), ("08007221100", P), ("0800-722-1100", P),
    ("phone: 3477-9330", f"phone: {P}"), ("fone 3477 9330", f"fone {P}"), ("WhatsApp: 98877-6655", f"WhatsApp: {P}"),
    ("31-3477-8100", P), ("11 98877-6655", P),
    ("ann (arroba) firm.org", E), ("ann[arroba]firm.org", E), ("write to ann@firm and go", f"write to {E} and go"), ("contact: ir@g7-firm.org.", f"contact: {E}."),
    ("(31) 3477-8100, ramal 223 e 224.", f"{P}."), ("(31) 3477-8100 ext. 12", P), ("(31) 3477-8100 - extensão 5/6, then", f"{P}, then"), ("(31) 3477-8100 extensao: 77", P),
    ("(31) 3477-8100 / (31) 3477-8101", P), ("(31) 3477-8100/ (31) 3477-8101/(31) 3477-8102 x", f"{P} x"), ("(31) 3477-8100 / 3477-8101", P), ("(31) 3477-8100 (31) 3477-8101", f"{P} {P}"),
    ("55 (21) 3485 3900", P), ("(11) 3477-8100/2024-05-06", f"{P}/2024-05-06"), ("Tel/Fax: 3477-9331", f"Tel/Fax: {P}"), ("Telephone - 3477-9331", f"Telephone - {P}"), ("Tel.: (31", f"Tel.: {P}"), ("at 55 31 349", f"at {P}"),
    ("Tel.: 55 31 3477.8000 Fax.: 55 31 3477.8001 ir@steel.org www.steel.org/ir", f"Tel.: {P} Fax.: {P} {E} www.steel.org/ir"),
    ("E-mail: ann.b", f"E-mail: {E}"), ("reach ann@", f"reach {E}"), ("reach ann@fir", f"reach {E}"), ("Tel.: 55 31 34", f"Tel.: {P}"), ("at (31) 347", f"at {P}"), ("at +55 11 98", f"at {P}"), ("at +44 20 79 46", f"at {P}"),
]
KEPT = ["from 2019-2023", "20082026", "(2019) 2020-2021", "on 12.08.2024", "CNPJ 12.345.678/0001-90", "R$ 1.234.567,89", "12,345,678", "30 140-071", "code 4711-0815-1", "see @handle now", "10:30-11:45", "item 12 2025-2026 of table (21) 2026-2027; annex 31 1999.2000 too", "06/11/2026, 06.11.2026, 2026-11-06 and 6/11/26", "NIRE 33.300.019.766 and 35-3.0000000.0 and 3530001234-1", "CEP 20030-900 (or 90.010-150)",
    "1.234.567.890 shares; 4.539.007.580 others; +1.234.567 more, +12,5% and +1.234.567.890", "R$ 123456789; US$ 200.000.000", "(B3: CSNA3; NYSE: SID), KLBN11, law 6.404/76", "15 123.456.789 1.234.567 (1) 123.456 12.345 12.345", "street 25, 1000; R. 7 de Setembro, 12", "31 3477-8100,55", "A31 3477-8100", "no contact here", "", None]


def both(spark, rows):
    got = spark.createDataFrame(list(enumerate(rows)), "i long, t string").orderBy("i").select(masked(F.col("t")).alias("a"), masked(masked(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in got)  # a second time changes nothing
    return [r.a for r in got]


def test_contacts(spark):
    got = both(spark, [c for c, _ in CASES])
    assert {c: g for (c, w), g in zip(CASES, got, strict=True) if g != w} == {}


def test_what_is_no_contact(spark):
    assert both(spark, KEPT) == KEPT


def test_long_texts(spark):
    text = "1 2 3 4 5 6 7 8 9 0 " * 5000 + "a" * 50_000 + " ann@firm.org"
    assert both(spark, [text])[0].endswith(f" {E}")
