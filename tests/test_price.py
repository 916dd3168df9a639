import pytest
from duskboard.functions import price as P


def test_range_only_for_a_wide_spread(spark):
    cases = {(9, 9): "9€", (21, 33): "33€", (50, 99): "99€", (50, 100): "50–100€", (13, 64): "13–64€", (0, 0): "0€", (0, 7): "0–7€"}
    df = spark.createDataFrame([(lo, hi) for lo, hi in cases], "lo int, hi int")
    got = {(r.lo, r.hi): r.p for r in df.select("lo", "hi", P.format_eur_range("lo", "hi").alias("p")).collect()}
    assert got == cases


def test_each_policy_has_its_own_words(evaluate):
    texts = ["exhaurit", "esgotades", "s.o.", "free entry", "accés lliure", "entrada lliure", "gratis"]
    got = {p: evaluate(lambda c, p=p: P.normalize_price(c, p), texts) for p in P.POLICIES}
    assert got == {
        "sold_free_amount": ["sold-out", None, None, None, None, None, None], "free_sold_amount": [None] * 7,
        "amount_sold_free": ["sold-out", "sold-out", "sold-out", "free", "free", None, None],
        "sold_amount_free": [None, None, "sold-out", "free", None, "free", None], "bundled_amount_free": [None] * 7,
    }


@pytest.mark.parametrize(
    "policy, cases",
    [
        ("sold_free_amount", {"11 €": "11€", "Gratuït": "free", "0 €": "free", "Exhaurit": "sold-out", "": None}),
        ("free_sold_amount", {"9 euros al web, 13 euros a la porta": "13€", "Entrada gratuïta": "free", "Preu: 8 € 21h": "8€", "10 € 20:30h": "10€",
                              "1.200 €": "1200€", "Freestyle 12 €": "12€", "Gluten-free sopar 30 €": "30€"}),
        ("amount_sold_free", {"De 14 € a 19 €": "19€", "De 14 € a 44 €": "14–44€", "A partir de 31 €": "31€", "per determinar": None,
                              "Accés lliure": "free", "exhaurit 13 €": "13€"}),
        ("sold_amount_free", {"€23": "23€", "€11-45": "11–45€", "€31,60": "32€", "Free talk, then a concert for €18": "18€", "Free if you book": "free"}),
        ("bundled_amount_free", {"Inclòs en el preu de l'entrada 6 €": "free", "4€ | socis gratuït": "4€"}),
    ],
)
def test_policies(evaluate, policy, cases):
    assert evaluate(lambda c: P.normalize_price(c, policy), list(cases)) == list(cases.values())


def test_member_tiers_are_cut(evaluate):
    got = evaluate(lambda c: P.cut_price_tiers(c), ["de 18 a 68 € (socis 9 €)", "32", "0 € i 700 €", "Concert per invitació"])
    assert got == [[18, 68], [32], [], []]


def test_structured_and_cents(spark):
    rows = [("12.0", "https://schema.org/InStock"), ("0", None), ("12", "https://schema.org/SoldOut"), ("n/a", None), (None, None)]
    df = spark.createDataFrame(rows, "p string, a string")
    assert [r[0] for r in df.select(P.structured_price("p", "a")).collect()] == ["12€", "free", "sold-out", None, None]
    cents = spark.createDataFrame([(["600", "750"],), (["600", "x"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in cents.select(P.cents_price("c")).collect()] == ["7,50€", "6€", None, None]
    df = spark.createDataFrame([("12.50", None), ("12.05", None), ("30", None), ("0.00", None), ("7.999", None), ("9", "x/SoldOut"), ("x", None)], "p string, a string")
    assert [r[0] for r in df.select(P.structured_price("p", "a", cents=True)).collect()] == ["12.5€", "12.05€", "30€", "free", "8€", "sold-out", None]
