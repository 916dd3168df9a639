from duskboard.functions import text as X


def test_entities_are_decoded_once(evaluate):
    got = evaluate(X.decode_entities, ["&#233; &#xE8; &euro; &#128512;", "&amp;lt;", "no"])
    assert got == ["é è € 😀", "&lt;", "no"]


def test_clean_and_strip(evaluate):
    assert evaluate(lambda c: X.clean_text(c, line_breaks=True), ["lleng­ uatges  del- \n cos"]) == ["llenguatges delcos"]
    page = "<style>x{}</style><!-- n --><p>Un <b>dos</b><script>var t='</p>';</script>&amp; tres"
    assert evaluate(X.strip_html, [page]) == ["Un dos & tres"]


def test_slug(evaluate):
    assert evaluate(X.slugify, ["UYARIY (ESCUCHAR) (VOE)", "L’Època d'Or: ça va?", "¡Añú!", "…"]) == ["uyariy", "lepoca-d-or-ca-va", "anu", ""]


def test_urls(evaluate):
    base = "https://www.example.org"
    cases = {"//cdn.example.org/a": "https://cdn.example.org/a", "/b": base + "/b", "c": base + "/c", "http://www.example.org/d": base + "/d",
             "https://other.org/e": "https://other.org/e", "": None}
    assert evaluate(lambda c: X.absolutize_url(c, base), list(cases)) == list(cases.values())
    assert evaluate(X.normalize_url, ["https://a.b/c/?x=1#y", "https://a.b/c#y"]) == ["https://a.b/c"] * 2
    assert evaluate(X.url_slug, ["https://a.b/c/d/?x"]) == ["d"]


def test_film_key(evaluate):
    assert evaluate(X.film_key, ["El Drama (VOSE)", "EL DRAMA", "LA LUZ [VO] ", "(500) dies"]) == ["el drama", "el drama", "la luz", "(500) dies"]


def test_packed_titles(evaluate):
    rows = evaluate(X.split_packed_title, ["20:30h | ANNA TRIO (jazz, soul) 11 €", "Jam (lliure)", "25:00h | X (a) (b) 5€", "Plain"])
    assert [(r.title, r.start_time, r.price, r.genres) for r in rows] == [
        ("ANNA TRIO", "20:30", "11€", ["jazz", "soul"]), ("Jam", None, "free", []), ("X (a)", None, "5€", ["b"]), ("Plain", None, None, [])]
    assert [tuple(r) for r in evaluate(X.split_series, ["A | B | C", "A |", "A"])] == [("A | B", "C"), ("A |", None), ("A", None)]
