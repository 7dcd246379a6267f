
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.functions import exprs
from souk.functions.quality import normalize_phone, word_count
from souk.operators import catalog, changes, documents, sales, stock
from souk.operators import quality as qa

D = dt.datetime
AS_OF = dt.date(2001, 6, 30)


def orders_df(spark, rows):
    return spark.createDataFrame(
        rows, "id bigint, status string, total decimal(14,2), created_at timestamp_ntz, "
              "first_name string, last_name string")


def test_status_buckets_and_cancelled_rules(spark):
    vals = ["cancelled", "CANCELLED", None, "", "Livré", "livrée", "en livraison", "refunded"]
    df = spark.createDataFrame([(v,) for v in vals], "status string")
    got = df.select(exprs.order_bucket("status").alias("b"), exprs.not_cancelled().alias("nc"),
                    (F.col("status") != "cancelled").alias("raw")).collect()
    assert [r.b for r in got] == ["cancelled", "cancelled", None, None, "delivered", None, "shipping", None]
    assert [r.nc for r in got] == [False, False, True, True, True, True, True, True]
    # the raw predicate drops NULL (three-valued logic) and is case-sensitive
    assert [r.raw for r in got] == [False, True, None, True, True, True, True, True]


def test_period_bounds(spark):
    start = D(2001, 6, 1)
    rows = [(1, "pending", Decimal("10.00"), start, "a", "b"),
            (2, "pending", Decimal("20.00"), start - dt.timedelta(microseconds=1), "a", "b"),
            (3, "pending", Decimal("30.00"), D(2001, 6, 30, 23, 59, 59), "a", "b"),
            (4, "delivered", Decimal("40.00"), D(2001, 7, 1), "a", "b"),
            (5, "pending", Decimal("50.00"), D(2001, 5, 2), "a", "b"),
            (6, "pending", Decimal("60.00"), D(2001, 5, 2) - dt.timedelta(microseconds=1), "a", "b")]
    o = orders_df(spark, rows)
    ov = sales.sales_overview(o, AS_OF, 30).first()
    assert ov.orders == 2 and ov.revenue == Decimal("40.00")
    assert ov.delivered_orders == 1  # no upper bound on the state counts
    prev = sales.sales_previous(o, AS_OF, 30).first()
    assert prev.orders == 2 and prev.revenue == Decimal("70.00")


@pytest.mark.parametrize("value,expected", [(None, 30), (0, 30), ("x", 30), (-5, 7), (1, 7), (7, 7), (400, 365)])
def test_clamp(value, expected):
    assert exprs.clamp_days(value, 7, 365) == expected


def test_delivery_rate_zero_denominator(spark):
    o = orders_df(spark, [(1, "cancelled", Decimal("1.00"), D(2001, 6, 10), None, None)])
    r = sales.delivery_summary(o, AS_OF, 30).first()
    assert r.rate == 0.0 and r.cancelled == 1
    empty = orders_df(spark, [])
    assert sales.delivery_summary(empty, AS_OF, 30).first().rate == 0.0


def test_customer_label(spark):
    o = orders_df(spark, [(1, "x", Decimal("1"), D(2001, 1, 1), None, ""),
                          (2, "x", Decimal("1"), D(2001, 1, 2), "Ana", None),
                          (3, "x", Decimal("1"), D(2001, 1, 3), "Ana", "Diop")])
    got = {r.id: r.customer for r in sales.recent_orders(o, 12).collect()}
    assert got == {1: "Client", 2: "Ana", 3: "Ana Diop"}


def test_category_performance(spark):
    offers = spark.createDataFrame(
        [(1, 1, Decimal("5"), "active"), (2, None, Decimal("7"), "active"), (3, 99, Decimal("1"), "cancelled"),
         (4, 2, Decimal("3"), "active")],
        "id bigint, category_id bigint, price decimal(14,2), status string")
    cats = spark.createDataFrame([(1, "Sans catégorie"), (2, "Shoes")], "id bigint, name string")
    rows = {(r.name, r.revenue, r.offers) for r in sales.category_performance(offers, cats).collect()}
    # the NULL name group and the category literally named 'Sans catégorie' stay apart
    assert rows == {("Sans catégorie", Decimal("5.00"), 1), ("Sans catégorie", Decimal("7.00"), 2),
                    ("Shoes", Decimal("3.00"), 1)}


def test_like_escape_fix():
    assert exprs.like_escape_fix(r"\a%") == "a%"
    assert exprs.like_escape_fix(r"\%x") == r"\%x"
    assert exprs.like_escape_fix("\\\\a") == "\\\\a"


def test_search_wildcards_and_case(spark):
    offers = spark.createDataFrame(
        [(1, "Écran", None, None, "active", 3, D(2001, 1, 1)),
         (2, "small", "x", "", "active", 1, D(2001, 1, 2)),
         (3, "a%b", None, None, "active", 1, D(2001, 1, 3)),
         (4, "small", None, None, "active", 0, D(2001, 1, 4))],
        "id bigint, product_name string, category string, description string, status string, "
        "quantity int, created_at timestamp_ntz")
    ids = lambda s: sorted(r.id for r in catalog.offers_filter(offers, search=s).collect())
    assert ids("écran") == [1]
    assert ids("sm_ll") == [2]
    assert ids(" a%b ") == [3]
    assert ids(r"\a%") == [1, 2, 3]  # "\a" is a plain "a"; the user "%" is a wildcard
    assert ids("   ") == [1, 2, 3]


def test_term_search_exact_paths(spark):
    offers = spark.createDataFrame(
        [(i, n, None, None, "active", 1, D(2001, 1, i)) for i, n in
         enumerate(["red bolt", "blue gear", "x", "ab", "r%d"], start=1)],
        "id bigint, product_name string, category string, description string, status string, "
        "quantity int, created_at timestamp_ntz")
    terms = spark.createDataFrame([("q1", "RED"), ("q2", "b_l"), ("q3", "__"), ("q4", r"r\%d"), ("q5", "zz")],
                                  "query_id string, term string")
    got = {}
    for r in catalog.term_search(terms, offers).collect():
        got.setdefault(r.query_id, set()).add(r.offer_id)
    assert got == {"q1": {1}, "q2": {1}, "q3": {1, 2, 4, 5}, "q4": {5}}


def test_term_search_cuts_lists_per_term(spark):
    n, top = 300, 5
    rows = [(i, f"bolt {'red' if i % 3 else 'blue'}", None, None, "active", 1, None if i == 7 else D(2001, 1, 1 + i % 28)) for i in range(n)]
    schema = "id bigint, product_name string, category string, description string, status string, quantity int, created_at timestamp_ntz"
    queries = [(q, t) for q in range(200) for t in (["bolt", "red"], ["blue", "bolt"], ["gear", "BLUE"], ["zz"])[q % 4]]
    out = catalog.term_search(spark.createDataFrame(queries, "query_id bigint, term string"), spark.createDataFrame(rows, schema), top)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.offer_id))
    for q in range(200):
        terms = [t.lower() for x, t in queries if x == q]
        at = {}
        for i, name, _, _, _, _, d in rows:
            if any(t in name for t in terms):
                at[i] = max(at.get(i, (False, D(1, 1, 1))), (d is None, d or D(1, 1, 1)))
        best = sorted(at, key=lambda i: (at[i], i), reverse=True)[:top]
        assert got.get(q, []) == list(enumerate(best, 1))
    p = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(term" in p  # a term's list is cut before queries look at it
    below = p.splitlines()
    for i, line in enumerate(below):  # the grams of a term are made per distinct term, not per row
        if "Filter" in line and "regexp_extract_all" in line:
            assert next(x for x in below[i + 1:] if "Aggregate" in x or "LogicalRDD" in x).count("Aggregate")


def test_paging_args():
    assert catalog.paging_args(0, 0) == (1, 1_000_000)
    assert catalog.paging_args(-1, "x") == (1, 1_000_000)
    assert catalog.paging_args("3", "25") == (3, 25)
    assert catalog.paging_args(" 12abc", "1e3") == (12, 1)
    assert catalog.paging_args("+4.9", "-7") == (4, 1)
    assert catalog.paging_args("x3", "") == (1, 1_000_000)


def test_main_image_ties_and_defaults(spark):
    offers = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    images = spark.createDataFrame(
        [(10, 1, "a", False, 0), (11, 1, "b", True, 2), (12, 1, "c", True, 1),
         (20, 2, None, True, 0), (21, 2, "z", None, 0)],
        "id bigint, offer_id bigint, image_url string, is_main boolean, sort_order int")
    got = {r.offer_id: r.image_url for r in catalog.main_image(offers, images).collect()}
    # is_main DESC puts NULL first (PostgreSQL), so image 21 wins for offer 2
    assert got == {1: "c", 2: "z", 3: "default.png"}


@pytest.mark.parametrize("raw,expected", [
    ("+221 77-123.45 67", "771234567"), ("00221771234567", "771234567"), ("771234567", "771234567"),
    ("761234", None), ("+33612345678", None), ("", None), (None, None), ("(77) 123 45 67", "771234567"),
    (" 771234567\t", "771234567")])
def test_phone(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(normalize_phone(F.col("p")).alias("x")).first().x == expected


def test_reference_number(spark):
    df = spark.createDataFrame([(7,), (999999,), (1000000,)], "id bigint")
    got = [r.reference for r in changes.reference_numbers(df, AS_OF).orderBy("id").collect()]
    assert got == ["REF-2001-000007", "REF-2001-999999", "REF-2001-1000000"]


def test_basket_totals(spark):
    offers = spark.createDataFrame([(1, None), (2, Decimal("2.50"))], "id bigint, new_price decimal(14,2)")
    lines = spark.createDataFrame([(1, 1, 3), (1, 2, 0), (1, 2, None)], "basket_id bigint, offer_id bigint, quantity int")
    r = documents.basket_totals(lines, offers).first()
    assert r.subtotal == Decimal("5.00") and r.total == Decimal("5.00")


def _invoice_items(spark, rows):
    return spark.createDataFrame(rows, "invoice_id bigint, created_at timestamp_ntz, offer_id bigint, "
                                       "line_no int, quantity int")


def test_invoice_stock_window(spark):
    offers = spark.createDataFrame([(1, "A", 3), (2, "B", None), (3, "C", 10)],
                                   "id bigint, product_name string, quantity int")
    items = _invoice_items(spark, [
        (100, D(2001, 1, 1), 1, 1, 5),      # stock 3 asked 5 -> available 3, missing 2
        (100, D(2001, 1, 1), 3, 2, 4),
        (100, D(2001, 1, 1), 3, 3, 4),      # same offer twice: both see 10
        (101, D(2001, 1, 2), 3, 1, 0),      # quantity 0 -> 1, sees 10 - 8 = 2
        (101, D(2001, 1, 2), 2, 2, 1),      # NULL stock -> 0 available
        (102, D(2001, 1, 1, 12), 9, 1, 1),  # unknown offer: whole invoice refused
        (102, D(2001, 1, 1, 12), 3, 2, 50)])
    got = {(r.invoice_id, r.line_no): (r.requested, r.available, r.missing)
           for r in stock.invoice_stock_check(items, offers).collect()}
    assert got == {(100, 1): (5, 3, 2), (100, 2): (4, 10, None), (100, 3): (4, 10, None),
                   (101, 1): (1, 2, None), (101, 2): (1, 0, 1)}
    after = {r.id: r.quantity for r in stock.stock_after_invoices(items, offers).collect()}
    assert after == {1: 0, 2: 0, 3: 1}


def test_stock_sequential_simulation(spark):
    """The window formula equals invoice-by-invoice clamped decrements."""
    import random
    rnd = random.Random(7)
    offers = [(o, f"P{o}", rnd.choice([None, 0, 2, 5, 9])) for o in range(1, 6)]
    rows, t0 = [], D(2001, 1, 1)
    for inv in range(1, 40):
        ts = t0 + dt.timedelta(hours=rnd.randrange(0, 200))
        for ln in range(1, rnd.randrange(2, 5)):
            rows.append((inv, ts, rnd.randrange(1, 6), ln, rnd.randrange(0, 4)))
    got = {(r.invoice_id, r.line_no): r.available for r in stock.invoice_stock_check(
        _invoice_items(spark, rows), spark.createDataFrame(offers, "id bigint, product_name string, quantity int")
    ).collect()}
    level = {o: q for o, _, q in offers}
    for inv in sorted({r[0] for r in rows}, key=lambda i: (next(r[1] for r in rows if r[0] == i), i)):
        lines = [r for r in rows if r[0] == inv]
        seen = {r[2]: max(0, level[r[2]] or 0) for r in lines}
        for r in lines:
            assert got[(inv, r[3])] == seen[r[2]]
        for r in lines:
            q = level[r[2]]
            level[r[2]] = max((q if q is not None else 0) - max(1, r[4] or 1), 0) if q is not None else 0


def test_word_count_without_match_objects(spark):
    ws = "\t\n\x0b\f\r \u00a0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\ufeff"
    texts = ["", " ", ws, "a", " a ", f"{ws}a{ws}b{ws}", "a\u200bb c", "\x85x \x1fy", "w " * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", word_count(F.col("t")).alias("n"))
    want = [max(1, sum(1 for w in "".join(" " if c in ws else c for c in t or "").split(" ") if w)) for t in texts]
    assert [r.n for r in df.orderBy("id").collect()] == want
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in p and "regexp_count" not in p  # a match object per word: four fifths of the gate's time


def test_alert_resolution(spark):
    alert = "array<struct<offerId:bigint,productName:string,requested:int,available:int,missing:int,resolved:boolean>>"
    inv = spark.createDataFrame(
        [(1, [(1, "A", 5, 3, 2, False)], False), (2, [(2, "B", 5, 3, 2, False)], False),
         (3, [(9, "Z", 5, 3, 2, False)], False), (4, [], False), (5, [(1, "A", 5, 3, 2, False)], True)],
        f"id bigint, stock_alerts {alert}, stock_alert_resolved boolean")
    offers = spark.createDataFrame([(1, 2), (2, 1)], "id bigint, quantity int")
    got = {r.id: (r.stock_alert_resolved, r.stock_alerts[0].resolved if r.stock_alerts else None)
           for r in stock.stock_alert_resolution(inv, offers, AS_OF).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, None), 5: (True, False)}


def test_main_image_reelect(spark):
    images = spark.createDataFrame(
        [(1, 1, "a", True, 0), (2, 1, "b", False, 1), (3, 1, "c", False, 1), (4, 2, "d", True, 0),
         (5, 2, "e", False, 1), (6, 3, "f", True, 0)],
        "id bigint, offer_id bigint, image_url string, is_main boolean, sort_order int")
    dels = spark.createDataFrame([(1,), (5,), (6,)], "id bigint")
    got = {r.id: r.is_main for r in changes.main_image_reelect(images, dels).collect()}
    assert got == {2: True, 3: False, 4: True}


def test_cart_upsert_rules(spark):
    offers = spark.createDataFrame([(1, "active"), (2, "inactive")], "id bigint, status string")
    base = spark.createDataFrame([(7, 1, 60, D(2024, 1, 1), D(2024, 1, 1)), (7, None, 1, D(2024, 1, 1), D(2024, 1, 1))],
                                 "cart_id bigint, offer_id bigint, quantity int, created_at timestamp_ntz, "
                                 "updated_at timestamp_ntz")
    adds = spark.createDataFrame(
        [(7, 1, 50, D(2024, 1, 2), 1), (7, 1, None, D(2024, 1, 3), 2), (7, 2, 1, D(2024, 1, 3), 3),
         (7, 1, 101, D(2024, 1, 4), 4), (7, None, 1, D(2024, 1, 4), 5)],
        "cart_id bigint, offer_id bigint, quantity int, ts timestamp_ntz, event_id bigint")
    got = sorted((r.offer_id, r.quantity) for r in changes.cart_upsert(base, adds, offers).collect()
                 if r.offer_id is not None)
    assert got == [(1, 111)]  # sum not capped; inactive and out-of-range adds dropped


def test_model_output(spark):
    words = " ".join(["w"] * 100)
    full = '"productName":"A","category":"c","description":"' + words + '"'
    rows = [(1, "```json {" + full + ',"confidence":2}```', (True, True, 1.0, 100, "[]")),
            (2, 'Sure! {"productName":"A","category":"c","description":"' + " ".join(["w"] * 99) + '","confidence":-1} thanks', (True, False, 0.0, 99, "[]")),
            (3, "no brace here", (False, False, 0.0, None, "[]")), (4, '{"productName": "A", broken}', (False, False, 0.0, None, "[]")),
            (5, "{" + full + ',"confidence":"x"}', (True, True, 0.0, 100, "[]")),
            (6, "{" + full + "} and {b}", (False, False, 0.0, None, "[]")),  # text after the object
            (7, "{" + full + '}, {"b":1}', (False, False, 0.0, None, "[]")),
            (8, "{" + full + ',"identifiedFeatures":"blue, round","confidence":"0.25"}', (True, True, 0.25, 100, "[]")),
            (9, "{" + full + ',"identifiedFeatures":["a",1],"confidence":true}', (True, True, 1.0, 100, '["a",1]')),
            (10, "{" + full.replace('"A"', "5") + "}", (True, True, 0.0, 100, "[]")),  # a number is truthy
            (11, "{" + full.replace('"A"', "0") + "}", (True, False, 0.0, 100, "[]")), (12, "{" + full.replace('"c"', "[]") + "}", (True, True, 0.0, 100, "[]")),
            (13, '{"productName":"A","category":"c","description":12}', (True, False, 0.0, None, "[]")),
            (14, "{" + full + ",}", (False, False, 0.0, None, "[]")), (15, "} {", (False, False, 0.0, None, "[]")), (16, "", (False, False, 0.0, None, "[]")),
            (17, None, (False, False, 0.0, None, "[]")), (18, "{" + full + ',"confidence":" 7e-1 "}', (True, True, 0.7, 100, "[]"))]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, raw string")
    got = {r.doc_id: (r.ok, r.passed, r.confidence, r.words, r.features) for r in qa.llm_json_gate(qa.llm_json_extract(df)).collect()}
    assert got == {i: v for i, _, v in rows}


@pytest.mark.parametrize("url,path", [
    ("https://h.example/a/b/../c", "/a/c"), ("https://h.example/a/./b/.", "/a/b/"), ("https://h.example/a/..", "/"),
    ("https://h.example/../../a", "/a"), ("https://h.example/a/%2e%2E/b", "/b"), ("https://h.example/a/.%2e/%2e/b", "/b"),
    ("https://h.example", "/"), ("https://h.example?x=/../", "/"), ("https://h.example/a//../b", "/a/b"), ("https://h.example/a/..b/c..", "/a/..b/c.."),
    ("  https:\\\\H.Example\\a\\..\\b c\n", "/b%20c"), ("https:h.example/a", "/a"), ("https://u:p@h.example:8080/a#/../x", "/a"),
    ("https://h.example/\u00e9{x}", "/%C3%A9%7Bx%7D"), ("ht\ttps://h.ex%61mple/a", "/a"), ("https://h.example:99999/a", None), ("https:///", None),
    ("not a url", None), ("", None), ("https://a b/c", None)])
def test_url_parse(spark, url, path):
    from souk.functions.quality import url_parts
    p = url_parts(F.col("u"))
    r = spark.createDataFrame([(url,)], "u string").select(p["protocol"].alias("p"), p["host"].alias("h"), p["path"].alias("x")).first()
    assert (r.p, r.h, r.x) == (("https:", "h.example", path) if path else (None, None, None))


def test_url_allowlist(spark):
    df = spark.createDataFrame([("https://res.cloudinary.com/x/shop/image-search/a.png",), ("http://res.cloudinary.com/shop/image-search/a.png",),
                                ("https://evil.com/shop/image-search/a.png",), ("https://res.cloudinary.com/shop/image-search/../a",), ("not a url",),
                                ("https://res.cloudinary.com/x/%2e%2e/shop/image-search/..a",), (None,)], "u string")
    got = [r.allowed for r in qa.url_allowlist(df, "u", "res.cloudinary.com", "/shop/image-search/").collect()]
    assert got == [True, False, False, False, False, True, False]


def test_dedupe_sources(spark):
    df = spark.createDataFrame([("r", 1, "u1", "a"), ("r", 2, "u2", None), ("r", 3, "u1", None), ("r", 4, None, "x")],
                               "response_id string, pos int, uri string, title string")
    got = {(r.uri, r.first_pos, r.title) for r in qa.dedupe_sources(df).collect()}
    assert got == {("u1", 1, ""), ("u2", 2, "")}


def test_stock_after_events_segments(spark):
    offers = spark.createDataFrame([(1, 3), (2, None), (3, 5)], "id bigint, quantity int")
    demand = spark.createDataFrame([(1, D(2024, 1, 1), 5), (1, D(2024, 1, 3), 1), (2, D(2024, 1, 1), 2),
                                    (3, D(2024, 1, 2), 1)], "offer_id bigint, ts timestamp_ntz, requested int")
    sets = spark.createDataFrame([(1, D(2024, 1, 2), 1, 4), (3, D(2024, 1, 2), 2, 9)],
                                 "offer_id bigint, ts timestamp_ntz, event_id bigint, quantity int")
    got = {r.id: r.quantity for r in stock.stock_after_events(offers, demand, sets).collect()}
    # 3 -5 -> 0, set 4, -1 -> 3;  NULL -2 -> 0;  set 9 then -1 at the same instant -> 8
    assert got == {1: 3, 2: 0, 3: 8}


# ---------------------------------------------------------------------------
# Profile updates one by one (M21), order headers (M6, M7)
# ---------------------------------------------------------------------------
def _simulate_profiles(users, updates):
    phones = dict(users)
    passed = []
    for event, user, ts, name, phone in sorted(updates, key=lambda r: (r[2], r[0])):
        p = "".join(ch for ch in phone if ch.isdigit())[-9:] if phone else None
        if not name.strip() or user not in phones or (phone and len(p) != 9):
            continue
        if p is not None and any(v == p for u, v in phones.items() if u != user):
            continue
        phones[user] = p
        passed.append(event)
    return phones, set(passed)


def test_profile_updates_equal_a_sequential_simulation(spark):
    import random
    rnd = random.Random(3)
    users = [(i, f"77000{i:04d}" if i % 5 else None) for i in range(60)]
    pool = [p for _, p in users if p][:25] + [f"76000{i:04d}" for i in range(12)]
    t0 = D(2024, 1, 1)
    updates = [(e, rnd.randrange(62), t0 + dt.timedelta(minutes=rnd.randrange(400)), rnd.choice(["A", " B ", " "]),
                rnd.choice([None, "", "123", *pool, *pool])) for e in range(900)]
    phones, passed = _simulate_profiles(users, updates)
    u = spark.createDataFrame([(i, f"n{i}", p, "g", "a") for i, p in users], "id bigint, full_name string, phone string, gender string, address string")
    upd = spark.createDataFrame([(*r, " f ", "  ") for r in updates],
                                "event_id bigint, user_id bigint, ts timestamp_ntz, full_name string, phone string, gender string, address string")
    assert {r.event_id for r in changes.profile_updates_accepted(u, upd.repartition(9)).collect()} == passed
    got = {r.id: r for r in changes.profile_update_apply(u, upd).collect()}
    assert {i: r.phone for i, r in got.items()} == phones
    last = {}
    for r in sorted(updates, key=lambda r: (r[2], r[0])):
        if r[0] in passed:
            last[r[1]] = r
    assert all(got[i].gender == ("f" if i in last else "g") and got[i].address == ("" if i in last else "a") for i in got)
    assert 0 < len(passed) < 700


def test_freed_phone_can_be_taken_again(spark):
    u = spark.createDataFrame([(1, "a", "771111111"), (2, "b", "772222222"), (3, "c", None)], "id bigint, full_name string, phone string")
    rows = [(1, 2, D(2024, 1, 1), "b", "771111111"), (2, 1, D(2024, 1, 2), "a", None), (3, 2, D(2024, 1, 3), "b", "771111111"),
            (4, 1, D(2024, 1, 4), "a", "772222222"), (5, 3, D(2024, 1, 5), "c", "771111111")]
    upd = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, full_name string, phone string")
    assert {r.event_id for r in changes.profile_updates_accepted(u, upd).collect()} == {2, 3, 4}
    got = {r.id: r.phone for r in changes.profile_update_apply(u, upd).collect()}
    assert got == {1: "772222222", 2: "771111111", 3: None}


def test_connected_components(spark):
    from souk.operators.graph import connected_components
    chain = [(i, i + 1) for i in range(100, 160)] + [(500, 400), (400, 300), (7, 7), (1, 9), (9, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[500] == got[300] == 300 and got[9] == 1 and got[7] == 7
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


HEADER = "request_id bigint, first_name string, last_name string, phone string, email string, delivery_method string, " \
         "address string, city string, district string, payment_method string"


def test_order_headers(spark):
    good = ("A", "B", "77", "", "home", "Rue", "City", "", "cash")
    rows = [(1, *good), (2, *good[:4], "pickup", None, None, "D", "cash"), (3, "", *good[1:]), (4, *good[:5], "", *good[6:]),
            (5, *good[:8], None), (6, *good[:6], None, *good[7:])]
    ok = {r.request_id for r in changes.valid_headers(spark.createDataFrame(rows, HEADER)).collect()}
    assert ok == {1, 2}
    offers = spark.createDataFrame([(1, "P", Decimal("2.50"), "active")], "id bigint, product_name string, new_price decimal(14,2), status string")
    images = spark.createDataFrame([], "id bigint, offer_id bigint, image_url string, is_main boolean, sort_order int")
    req = spark.createDataFrame([(i, 1, i, 2) for i in range(1, 8)] + [(2, None, 9, None)], "request_id bigint, offer_id bigint, line_no bigint, quantity int")
    orders = spark.createDataFrame([(41,)], "id bigint")
    h, items = changes.order_place_guest(req, offers, images, orders, AS_OF, spark.createDataFrame(rows, HEADER))
    r = h.collect()
    assert [(x.id, x.request_id, x.reference, x.email, x.address, x.city, x.district, x.total) for x in r] == \
        [(42, 1, "REF-2001-000042", None, "Rue", "City", None, Decimal("5.00"))]  # request 2: a line without offer
    assert [(x.order_id, x.line_no, x.image_url) for x in items.collect()] == [(42, 1, "default.png")]


# ---------------------------------------------------------------------------
# Search index, hot offers, invoice admission, image cap, documents, sinks
# ---------------------------------------------------------------------------
def test_search_candidates_hold_every_match_and_little_else(spark):
    from souk.sources import Tables
    t = Tables(spark, "/root/testdata/sf0.01")
    offers = catalog.sellable(t.v_offers)
    odd = [("q", x) for x in ("red", "RED%B", "b_l", "_", "%", "zzzz", "e", "st\\%", "anod", "promo", "blue plate", "o", "  ", "a_c%d")]
    terms = t.v_search_terms.unionByName(spark.createDataFrame(odd, "query_id string, term string"))
    cand = catalog.term_candidates(terms, offers).cache()
    pairs = terms.select("term").distinct().crossJoin(offers.select(F.col("id").alias("offer_id"), *catalog.SEARCH_COLUMNS))
    hits = pairs.where(catalog.search_condition(exprs.contains_pattern(F.col("term")))).select("term", "offer_id").cache()
    assert hits.join(cand, ["term", "offer_id"], "left_anti").count() == 0 and cand.count() == cand.distinct().count()
    own = t.v_search_terms.select("term").distinct()
    n, m = cand.join(own, "term", "left_semi").count(), hits.join(own, "term", "left_semi").count()
    # beyond the pairs that do match, fewer than 1 % of all pairs are looked at
    assert n - m < 0.01 * own.count() * offers.count()


def test_clean_terms_and_image_search(spark):
    rows = [(1, " red bolt ", None, ["", None, "x", " ab\u00a0", "red"]), (2, "", "", None), (3, None, "tool", [f"t{i}" for i in range(20)])]
    a = spark.createDataFrame(rows, "query_id bigint, product_name string, category string, search_terms array<string>")
    got = {r.query_id: r.terms for r in catalog.clean_terms(a).collect()}
    assert got[1] == ["red bolt", "ab", "red"] and got[2] == [] and got[3] == ["tool"] + [f"t{i}" for i in range(9)]
    offers = spark.createDataFrame([(i, n, None, "d", Decimal("1.00"), "active", 1, D(2001, 1, i)) for i, n in enumerate(["red bolt", "tool t8", "t19"], 1)],
                                   "id bigint, product_name string, category string, description string, new_price decimal(14,2), status string, "
                                   "quantity int, created_at timestamp_ntz")
    images = spark.createDataFrame([(1, 2, "u", True, 0)], "id bigint, offer_id bigint, image_url string, is_main boolean, sort_order int")
    out = catalog.image_search(a, offers, images).collect()
    assert [(r.query_id, r.rank, r.offer_id, len(r.images)) for r in out] == [(1, 1, 1, 0), (3, 1, 3, 0), (3, 2, 2, 1)]  # t1 is in t19


def test_hot_offer_spreads_over_ranges(spark):
    n = 6000
    items = spark.range(n).select(F.col("id").alias("invoice_id"), F.lit("2001-05-05 00:00:00").cast("timestamp_ntz").alias("created_at"),
                                  F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500 + 2).cast("long").alias("offer_id"),
                                  F.lit(1).alias("line_no"), (F.col("id") % 4).cast("int").alias("quantity"))
    offers = spark.range(1, 503).select("id", F.lit("p").alias("product_name"), F.lit(100).alias("quantity"))
    rows = stock.invoice_stock_check(items, offers).collect()
    level = {}
    for r in sorted(rows, key=lambda r: r.invoice_id):
        left = level.get(r.offer_id, 100)
        assert r.available == left
        level[r.offer_id] = max(left - r.requested, 0)
    from souk.operators.common import asc, range_bucket
    g = range_bucket(items, [asc("offer_id"), asc("created_at"), asc("invoice_id")], 64)
    per = [r["count"] for r in g.where("offer_id = 1").groupBy("_bucket").count().collect()]
    assert len(per) > 12 and max(per) < n / 10


def test_alert_resolution_is_one_pass(spark):
    alert = "array<struct<offerId:bigint,productName:string,requested:int,available:int,missing:int,resolved:boolean>>"
    inv = spark.createDataFrame([(1, [(2, "B", 5, 3, 2, False), (1, "A", 5, 3, 2, False)], False, None, "x"), (2, None, False, None, "y"),
                                 (3, [], None, None, "z"), (4, [(1, "A", 9, 3, 2, False), (None, "A", 9, 3, 2, False)], None, None, "w")],
                                f"id bigint, stock_alerts {alert}, stock_alert_resolved boolean, stock_alert_resolved_at timestamp_ntz, note string")
    offers = spark.createDataFrame([(1, 2), (2, 7)], "id bigint, quantity int")
    out = stock.stock_alert_resolution(inv, offers, AS_OF)
    got = {r.id: r for r in out.collect()}
    assert [a.offerId for a in got[1].stock_alerts] == [2, 1] and all(a.resolved for a in got[1].stock_alerts)
    assert got[1].stock_alert_resolved and got[1].stock_alert_resolved_at == D(2001, 6, 30) and got[1].note == "x"
    assert got[2].stock_alerts is None and got[3].stock_alerts == [] and got[3].stock_alert_resolved is None
    assert got[4].stock_alert_resolved is None and not any(a.resolved for a in got[4].stock_alerts) and out.columns == inv.columns
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 1 and plan.count("Aggregate") == 1


REQ = "invoice_id bigint, created_at timestamp_ntz, number string, customer_name string, customer_phone string, customer_address string, " \
      "subtotal decimal(14,2), discount decimal(14,2), total decimal(14,2), amount_received decimal(14,2), change_amount decimal(14,2), " \
      "payment_method string, note string"


def test_invoice_admission_before_stock(spark):
    none = (None,) * 3
    money = (Decimal("1.00"), None, Decimal("1.00"), None, None)
    rows = [(1, D(2001, 1, 2), "A", "N", *none[:2], *money, "", ""), (2, D(2001, 1, 1), "A", *none, *money, "card", "n"),  # 2 is earlier: it wins
            (3, D(2001, 1, 1), "", *none, *money, "x", None), (4, D(2001, 1, 3), "OLD", *none, *money, "x", None),
            (5, D(2000, 1, 1), "B", *none, *money, "x", None), (6, D(2001, 1, 4), "B", *none, *money, None, None),  # 5 has an unknown product
            (7, D(2001, 1, 5), "C", *none, *money, "x", None)]  # no lines
    items = _invoice_items(spark, [(i, D(2001, 1, d), o, 1, 2) for i, d, o in ((1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 3, 1), (5, 1, 9), (6, 4, 1))])
    offers = spark.createDataFrame([(1, "A", 3)], "id bigint, product_name string, quantity int")
    known = spark.createDataFrame([(70, "OLD")], "id bigint, invoice_number string")
    h, lines = stock.invoice_create(spark.createDataFrame(rows, REQ), items, offers, known, ["line_no", "offer_id"])
    got = {r.invoice_id: r for r in h.collect()}
    assert {(r.id, r.invoice_id, r.invoice_number) for r in got.values()} == {(71, 2, "A"), (72, 6, "B")}
    assert got[2].stock_status == "verified" and got[6].stock_status == "stock_insuffisant"  # refused ones took no stock: 3 - 2 = 1 is left
    assert got[6].payment_method == "Espèces" and got[2].payment_method == "card" and got[6].discount == 0 and got[2].note == "n"
    assert {(r.invoice_id, r.available) for r in lines.collect()} == {(2, 3), (6, 1)} and got[6].stock_alerts[0].missing == 1


def test_image_cap_counts_earlier_updates(spark):
    import random
    rnd = random.Random(9)
    images = spark.createDataFrame([(i, i % 4) for i in range(10)], "id bigint, offer_id bigint")
    have = {o: sum(i % 4 == o for i in range(10)) for o in range(6)}
    rows = [(o, D(2001, 1, 1 + rnd.randrange(20)), 1000 * o + e, rnd.choice([None, 0, -1, 1, 2, 3, 5, 8, 9])) for o in range(6) for e in range(60)]
    rows += [(9, D(2001, 1, 1), 90001, 5), (9, D(2001, 1, 2), 90002, 5)]  # two updates of five images on one offer
    got = {r.event_id for r in changes.within_image_cap(spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, event_id bigint, new_images int"), images).collect()}
    want, at = set(), dict(have)
    for o, ts, e, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if (n or 0) <= 0:
            want.add(e)
        elif at.get(o, 0) + n <= 8:
            at[o] = at.get(o, 0) + n
            want.add(e)
    assert got == want and 90001 in got and 90002 not in got


def test_generated_offers(spark):
    good = ("P", "c", "d", Decimal("3.00"), Decimal("0"), None, None, None, "")
    rows = [(1, *good, 0), (2, *good, 0), (3, *good, 8), (4, *good, 1), (5, "", *good[1:], 2), (6, *good[:3], Decimal("0"), *good[4:], 2), (7, *good, None)]
    req = spark.createDataFrame(rows, "request_id bigint, product_name string, category string, description string, new_price decimal(14,2), "
                                      "old_price decimal(14,2), discount int, wholesale_price decimal(14,2), quantity int, status string, n_files int")
    url = "https://res.cloudinary.com/x.png"
    pics = [(1, 2, url, "shop/ai-generated/b"), (1, 1, url, "shop/ai-generated/a"), (2, 1, url, "shop/ai-generated/../a"), (3, 1, url, "shop/ai-generated/a"),
            (4, 1, "http://res.cloudinary.com/x.png", "shop/ai-generated/a")]
    images = spark.createDataFrame(pics, "request_id bigint, pos int, url string, public_id string")
    made, out = changes.offer_create_generated(req, images, spark.createDataFrame([(10,)], "id bigint"), AS_OF)
    r = made.collect()
    assert [(x.id, x.request_id, x.reference, x.discount, x.quantity, x.status, x.old_price) for x in r] == [(11, 1, "REF-2001-000011", 0, 0, "active", None)]
    assert sorted((x.offer_id, x.public_id, x.sort_order, x.is_main) for x in out.collect()) == \
        [(11, "shop/ai-generated/a", 0, True), (11, "shop/ai-generated/b", 1, False)]


def test_documents_and_report(spark):
    import json

    from souk.sources import documents as as_json
    from souk.sources import report_document
    df = spark.createDataFrame([(1, None, Decimal("2.50"), D(2001, 1, 2, 3, 4, 5, 678900), [(1, None)], dt.date(2001, 1, 2), None), (2, "é\"", None, None, [], None, (7,))],
                               "id bigint, name string, price decimal(10,2), at timestamp_ntz, lines array<struct<a:int,b:decimal(5,1)>>, day date, s struct<x:int>")
    got = {r.id: r.document for r in as_json(df, "id").collect()}
    assert got[1] == '{"id":1,"name":null,"price":"2.50","at":"2001-01-02T03:04:05.678Z","lines":[{"a":1,"b":null}],"day":"2001-01-02","s":null}'
    assert json.loads(got[2]) == {"id": 2, "name": 'é"', "price": None, "at": None, "lines": [], "day": None, "s": {"x": 7}}
    doc = report_document({"one": df.where("id = 1").select("name", "price"), "all": df.select("id"), "none": df.limit(0).select("id"),
                           "empty": df.limit(0).select("name")}, {"all": ["id"], "none": ["id"]}).collect()
    assert json.loads(doc[0].document) == {"one": {"name": None, "price": "2.50"}, "all": [{"id": 1}, {"id": 2}], "none": [], "empty": None}


def test_append_batch_is_idempotent(spark, tmp_path):
    from souk.sources import append_batch
    path = str(tmp_path / "sink")
    a, b = spark.range(5).withColumn("v", F.lit("a")), spark.range(3).withColumn("v", F.lit("b"))
    for batch in ("b1", "b2", "b1", "b1"):
        append_batch(a if batch == "b1" else b, path, batch)
    append_batch(a.limit(0), path, "b3")
    got = sorted((r.batch_id, r.id, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("b1", i, "a") for i in range(5)] + [("b2", i, "b") for i in range(3)]


def test_missing_tables_and_expiry(spark):
    o = orders_df(spark, [(1, "x", Decimal("1"), D(2001, 6, 10), None, None)])
    assert sales.items_sold(None, o, AS_OF, 30).first().items_sold == 0
    offers = spark.createDataFrame([(1, 1)], "id bigint, category_id bigint")
    assert sales.category_performance(offers, None).count() == 0
    assert sales.category_performance(offers.drop("category_id"), offers).count() == 0
    t = spark.createDataFrame([(1, "h", D(2001, 1, 2)), (1, "h", D(2001, 1, 3)), (2, "h", D(2001, 1, 1)), (3, "h", None)],
                              "user_id bigint, token_hash string, expires_at timestamp_ntz")
    p = spark.createDataFrame([(i, i, "h") for i in (1, 2, 3, 4)], "event_id bigint, user_id bigint, token_hash string")
    assert [r.event_id for r in changes.tokens_valid(t, p, "2001-01-01 00:00:00").collect()] == [1]


def test_lists_come_newest_first(spark):
    rows = [(i, 1 + i % 3, "pickup", "x", Decimal("1.00"), None if i == 7 else D(2001, 1, 1 + i % 9), None, None, None) for i in range(40)]
    o = spark.createDataFrame(rows, "id bigint, user_id bigint, delivery_method string, status string, total decimal(14,2), created_at timestamp_ntz, "
                                    "city string, district string, address string").repartition(5)
    items = spark.createDataFrame([(i, i % 40, 2) for i in range(90)], "id bigint, order_id bigint, quantity int")
    key = lambda at, i: (at is not None, -at.timestamp() if at else 0, -i)
    got = [(r.created_at, r.id) for r in documents.orders_admin(o, items, nested=False).collect()]
    assert got == sorted(got, key=lambda x: key(*x))
    got = [(r.user_id, r.date, r.id) for r in documents.order_history(o, items).collect()]
    assert got == sorted(got, key=lambda x: (x[0], *key(*x[1:])))
    inv = o.select("id", "created_at")
    got = [(r.created_at, r.id, r.line_pos) for r in documents.invoices_with_items(inv, items.withColumnRenamed("order_id", "invoice_id"), nested=False).collect()]
    assert got == sorted(got, key=lambda x: (*key(*x[:2]), x[2]))
