import random

import pytest
from pyspark.sql import functions as F

from fraudloom.operators import maintain, shop, validate


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cards_of_user(spark):
    cards = spark.createDataFrame([(1, "1234", 7), (2, "4242", 1)], "id long, card_number string, user_id long")
    own = shop.cards_of_user(cards, spark.createDataFrame([(7,)], "user_id long"))
    assert rows(own, "card_number") == [("1234",)]


def test_search_terms_with_capitals_match_nothing(spark):
    products = spark.createDataFrame([(1, "Apple Watch"), (2, None)], "id long, name string")
    assert rows(shop.product_search(products, ["watch", "Watch"]), "id", "term") == [(1, "watch")]
    assert rows(shop.product_search(products, ["Watch"], normalise_term=True), "id", "term") == [(1, "Watch")]


def test_orders_for_pushes_the_owner_filter(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.createDataFrame([(1, 7), (2, 8)], "id long, user_id long").write.parquet(path)
    orders = spark.read.parquet(path)
    assert shop.orders_for(orders, 7, True).count() == 2
    mine = shop.orders_for(orders, 7, False)
    assert mine.count() == 1
    assert "EqualTo(user_id,7)" in mine._jdf.queryExecution().executedPlan().toString()


def test_address_update_keeps_blanks(spark):
    base = spark.createDataFrame([(1, "A", "Pune", "111111")], "id long, name string, city string, pin_code string")
    changes = spark.createDataFrame(
        [(1, 1, "", "Goa", "2"), (2, 1, "", "Mumbai", "222222")],
        "request_id long, id long, name string, city string, pin_code string",
    )
    got = maintain.apply_updates_keep_blank(base, changes, ["name", "city", "pin_code"])
    assert rows(got, *got.columns) == [(1, "A", "Mumbai", "222222")]


def test_product_update_always_sets_stock(spark):
    base = spark.createDataFrame([(1, "Watch", "399.99", True)], "id long, name string, price string, stock boolean")
    base = base.withColumn("price", F.col("price").cast("decimal(8,2)"))
    changes = spark.createDataFrame(
        [(1, 1, "", "400.99", False)], "request_id long, id long, name string, price string, stock boolean"
    )
    got = maintain.apply_updates_keep_blank(base, changes, ["name", "price"], always=["stock"]).first()
    assert (got["name"], float(got["price"]), got["stock"]) == ("Watch", 400.99, False)


def test_only_owners_and_staff_change(spark):
    base = spark.createDataFrame([(1, 7), (2, 8)], "id long, user_id long")
    changes = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 9, 7)], "request_id long, id long, requester_id long")
    kept, refused = maintain.owned_changes_only(base, changes)
    assert rows(kept, "request_id") == [(1,)]
    assert rows(refused, "request_id", "reason") == [(2, "Permission denied."), (3, "Not found.")]
    users = spark.createDataFrame([(7, True), (8, False)], "id long, is_staff boolean")
    kept, refused = maintain.admin_changes_only(changes.withColumn("requester_id", F.lit(8)), users)
    assert kept.count() == 0 and refused.count() == 3


def greedy(users, requests):
    names, mails, out = {u for u, _ in users}, {e for _, e in users}, {}
    for i, u, e in sorted(requests):
        if not u or not e:
            out[i] = maintain.BLANK_USER
        elif u in names:
            out[i] = maintain.USERNAME_TAKEN
        elif e in mails:
            out[i] = maintain.EMAIL_TAKEN
        else:
            out[i] = None
            names.add(u)
            mails.add(e)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_registration_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    users = [("u0", "m0"), ("u1", "m1")]
    requests = [
        (i, rng.choice([f"u{rng.randrange(25)}", ""] if i % 9 == 0 else [f"u{rng.randrange(25)}"]),
         f"m{rng.randrange(25)}") for i in range(120)
    ]
    taken, refused = maintain.register_users(
        spark.createDataFrame(users, "username string, email string"),
        spark.createDataFrame(requests, "request_id long, username string, email string"),
    )
    got = {r["request_id"]: None for r in taken.collect()} | {r["request_id"]: r["reason"] for r in refused.collect()}
    assert got == greedy(users, requests)


def test_saved_cards_are_unique(spark):
    cards = spark.createDataFrame([("1",), (None,)], "card_number string")
    schema = ("request_id long, card_number string, email string, customer_id string, exp_month string, "
              "exp_year string, card_id string, user_id long, save_card boolean")
    requests = spark.createDataFrame(
        [(i, n, "e", "c", "1", "2030", "x", 1, s) for i, n, s in
         [(1, "1", True), (2, "2", True), (3, "2", True), (4, None, True), (5, None, True), (6, "9", False)]], schema)
    saved, refused = maintain.save_cards(cards, requests)
    assert rows(saved, "request_id") == [(2,), (4,), (5,)]
    assert rows(refused, "request_id") == [(1,), (3,)]


def test_validation(spark):
    df = spark.createDataFrame(
        [(1, "9876543210", "411001"), (2, "12ab", "411001"), (3, "9876543210", "4110011")],
        "id long, phone_number string, pin_code string",
    ).select("id", "phone_number", "pin_code", *[F.lit("x").alias(c) for c in ("name", "house_no", "landmark", "city", "state")])
    accepted, refused = validate.validate_addresses(df)
    assert rows(accepted, "id") == [(1,)]
    assert rows(refused, "id", "reason") == [(2, "phone_number: bad format"), (3, "pin_code: longer than 6")]
    prices = spark.createDataFrame([(1, "12.5%"), (2, "12.345"), (3, "")], "id long, price string")
    got = rows(validate.validate_form_rules(prices, "product", 2024), "id", "reason")
    assert got == [(2, "price: bad format"), (3, "price: required")]


def test_long_chain_of_clashing_registrations(spark):
    """Request i shares its username with i - 1 when i is odd and its e-mail when i is even: every other one is refused."""
    from fraudloom.operators import maintain

    rows = [(i, f"u{(i + 1) // 2}", f"m{i // 2}@x") for i in range(24)]
    users = spark.createDataFrame([(1, "other", "other@x")], "id long, username string, email string")
    taken, refused = maintain.register_users(users, spark.createDataFrame(rows, "request_id long, username string, email string"))
    assert sorted(r["request_id"] for r in taken.collect()) == list(range(0, 24, 2))
    assert sorted(r["request_id"] for r in refused.collect()) == list(range(1, 24, 2))


def test_ownerless_rows_are_there_but_denied(spark):
    from fraudloom.operators import maintain

    base = spark.createDataFrame([(1, None), (2, 7)], "id long, user_id long")
    changes = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 9, 7), (4, 2, None)], "request_id long, id long, requester_id long")
    kept, refused = maintain.owned_changes_only(base, changes)
    assert [r["request_id"] for r in kept.collect()] == [2]
    assert {r["request_id"]: r["reason"] for r in refused.collect()} == {1: maintain.DENIED, 3: maintain.NOT_FOUND, 4: maintain.DENIED}


def settled_by_hand(rows):
    names, mails, out = set(), set(), {}
    for i, name, mail in sorted(rows):
        out[i] = maintain.USERNAME_TAKEN if name in names else maintain.EMAIL_TAKEN if mail in mails else None
        if out[i] is None:
            names.add(name)
            mails.add(mail)
    return out


@pytest.mark.parametrize("together", [50_000, 300])
def test_long_chains_of_clashes(spark, together):
    rng = random.Random(4)
    rows = [(i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(4000 if together > 4000 else 200)]  # each clashes with the one before
    rows += [(10_000 + i, f"n{rng.randint(0, 150)}", f"m{rng.randint(0, 150)}") for i in range(400)]
    rows += [(20_000 + i, "hot", f"h{i}") for i in range(500)] + [(30_000 + i, f"lone{i}", f"lone{i}") for i in range(50)]
    rng.shuffle(rows)
    schema = "request_id long, username string, email string"
    users = spark.createDataFrame([], "id long, username string, email string, is_staff boolean")
    taken, refused = maintain.register_users(users, spark.createDataFrame(rows, schema), together)
    got = {r["request_id"]: None for r in taken.collect()} | {r["request_id"]: r["reason"] for r in refused.collect()}
    assert got == settled_by_hand(rows)
