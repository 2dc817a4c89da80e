"""Batch changes to shop tables: a table and a change set give a new table.

A table's key is unique; a change set may name a key many times, so it is
reduced per key by an aggregate before any join. Requests are told apart by
their own unique ``request_id``, which also gives their order.
"""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators.components import connected_components
from fraudloom.plans.sizing import sized
from fraudloom.session import cut_lineage

# Answers given to refused requests.
DENIED = "Permission denied."
NOT_FOUND = "Not found."
BLANK_USER = "username or email cannot be empty"
USERNAME_TAKEN = "A user with that username already exist!"
EMAIL_TAKEN = "A user with that email address already exist!"
CARD_IN_USE = "Card already in use, please uncheck save card option or select a card from saved card list."
EMAIL_MISMATCH = "Your email address does not belong to the provided card."
CARD_MISMATCH = "Invalid Card Details Provided."


def latest_changes(changes: DataFrame, key: str, order: str = "request_id") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("c")).select(key, "c.*")


def _update(base: DataFrame, changes: DataFrame, key: str, new: dict[str, Column]) -> DataFrame:
    """Replace columns where a change exists; ``new`` may use ``n_<column>``."""
    side = changes.select(
        F.col(key), F.lit(True).alias("_changed"),
        *[F.col(c).alias(f"n_{c}") for c in changes.columns if c != key],
    )
    joined = base.join(side, key, "left")
    changed = F.coalesce(F.col("_changed"), F.lit(False))
    return joined.select(
        *[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns]
    )


def apply_updates_keep_blank(
    base: DataFrame, changes: DataFrame, columns: list[str], key: str = "id",
    always: list[str] | None = None, order: str = "request_id",
) -> DataFrame:
    """Blank new values keep the old; ``always`` columns are taken as they come."""
    types = dict(base.dtypes)
    new = {c: F.coalesce(text.blank_to_null(F.col(f"n_{c}").cast("string")).cast(types[c]), F.col(c)) for c in columns}
    new |= {c: F.col(f"n_{c}").cast(types[c]) for c in always or []}
    return _update(base, latest_changes(changes, key, order), key, new)


def apply_user_updates(
    users: DataFrame, changes: DataFrame, blank: str = "overwrite", order: str = "request_id"
) -> DataFrame:
    """Username and e-mail; blanks overwrite (the server's rule) or keep (the form's)."""
    if blank not in ("overwrite", "keep"):
        raise ValueError(f"blank must be 'overwrite' or 'keep', not {blank!r}")
    keep = blank == "keep"
    new = {c: text.keep_if_blank(f"n_{c}", c) if keep else F.col(f"n_{c}") for c in ("username", "email")}
    return _update(users, latest_changes(changes, "id", order), "id", new)


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.blank_to_null(c) for c in columns})


def _judged(judged: DataFrame, columns: list[str], request: str) -> tuple[DataFrame, DataFrame]:
    kept = judged.filter(F.col("_reason").isNull()).select(*columns)
    refused = judged.filter(F.col("_reason").isNotNull()).select(request, F.col("_reason").alias("reason"))
    return kept, refused


def owned_changes_only(
    base: DataFrame, changes: DataFrame, key: str = "id", owner: str = "user_id",
    requester: str = "requester_id", request: str = "request_id",
) -> tuple[DataFrame, DataFrame]:
    """Changes by a row's owner; the rest with the reason they are refused.

    A row without an owner is there, but nobody may change it.
    """
    owners = base.select(F.col(key), F.col(owner).alias("_owner"), F.lit(True).alias("_there"))
    is_owner = F.coalesce(F.col("_owner") == F.col(requester), F.lit(False))
    reason = F.when(F.col("_there").isNull(), NOT_FOUND).when(~is_owner, DENIED)
    judged = changes.join(owners, key, "left").withColumn("_reason", reason)
    return _judged(judged, changes.columns, request)


def admin_changes_only(
    changes: DataFrame, users: DataFrame, requester: str = "requester_id", request: str = "request_id"
) -> tuple[DataFrame, DataFrame]:
    staff = users.filter("is_staff").select(F.col("id").alias(requester), F.lit(True).alias("_staff"))
    judged = changes.join(staff, requester, "left").withColumn("_reason", F.when(F.col("_staff").isNull(), DENIED))
    return _judged(judged, changes.columns, request)


def delete_by_key(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def delete_users_cascade(
    users: DataFrame, children: dict[str, DataFrame], gone: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Remove users and every child row they own."""
    kept = delete_by_key(users, gone)
    owners = gone.select(F.col("id").alias("user_id"))
    return kept, {name: child.join(owners, "user_id", "left_anti") for name, child in children.items()}


#: Requests of one clash component, or of several together, that one task may settle in order.
SETTLED_TOGETHER = 50_000


def register_users(
    users: DataFrame, requests: DataFrame, together: int = SETTLED_TOGETHER
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of registrations taken in ``request_id`` order.

    A request fails on a blank field, then on a username, then on an e-mail held
    by a user or by an earlier accepted request. Requests that share a username or
    an e-mail, directly or through others, make a component. Components of up to
    ``together`` requests are settled in order, many to a task, however long their
    chains of clashes; larger ones, which a hot name or e-mail makes, in rounds of
    all that are first for both their keys.
    """
    blank = text.blank_to_null("username").isNull() | text.blank_to_null("email").isNull()
    names, mails = users.select("username"), users.select("email")
    unnamed, filled = requests.filter(blank), requests.filter(~blank)
    free = filled.join(names, "username", "left_anti")
    refused = [
        _refuse(unnamed, BLANK_USER),
        _refuse(filled.join(names, "username", "left_semi"), USERNAME_TAKEN),
    ]
    open_ = cut_lineage(free.join(mails, "email", "left_anti").select(*requests.columns))
    accepted, clashing = [open_.limit(0)], [free.join(mails, "email", "left_semi")]
    components = _clash_components(open_)
    if components is None:
        accepted.append(open_)
        open_ = open_.limit(0)
    else:
        accepted.append(open_.join(components, "request_id", "left_anti"))
        sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        small, large = sizes.filter(F.col("n") <= together), sizes.filter(F.col("n") > together)
        told = cut_lineage(_in_order(open_.join(components, "request_id").join(small, "component"), together))
        won = told.filter("reason IS NULL").select("request_id")
        accepted.append(open_.join(won, "request_id", "left_semi"))
        refused.append(told.filter("reason IS NOT NULL"))
        open_ = cut_lineage(open_.join(components.join(large, "component", "left_semi"), "request_id", "left_semi"))
    while not open_.isEmpty():
        by_name = open_.groupBy("username").agg(F.min("request_id").alias("first_u"))
        by_mail = open_.groupBy("email").agg(F.min("request_id").alias("first_e"))
        # a request that leads both its groups is one row of each grouped table
        both = by_name.join(by_mail, F.col("first_u") == F.col("first_e"))
        leads = cut_lineage(both.select(F.col("first_u").alias("request_id"), "username", "email"))
        if not leads.limit(1).count():
            break
        ids, names, mails = leads.select("request_id"), leads.select("username"), leads.select("email")
        accepted.append(open_.join(ids, "request_id", "left_semi"))
        rest = open_.join(ids, "request_id", "left_anti")
        apart = rest.join(names, "username", "left_anti")
        clashing += [rest.join(names, "username", "left_semi"), apart.join(mails, "email", "left_semi")]
        open_ = cut_lineage(apart.join(mails, "email", "left_anti").select(*requests.columns))
    taken = cut_lineage(_union(accepted, requests.columns))
    # the username is checked first, against every accepted request before this one
    holders = taken.select("username", F.col("request_id").alias("_holder"))
    late = _union(clashing, requests.columns).join(holders, "username", "left")
    by_username = F.col("_holder") < F.col("request_id")
    reason = F.when(by_username, USERNAME_TAKEN).otherwise(EMAIL_TAKEN)
    refused.append(late.select("request_id", reason.alias("reason")))
    return taken, _union(refused, ["request_id", "reason"])


def _clash_components(open_: DataFrame) -> DataFrame | None:
    """(request_id, component) of the requests that share a username or an e-mail with another; None if there are none."""
    stars = []
    for key in ("username", "email"):
        first = open_.groupBy(key).agg(F.min("request_id").alias("a"), F.max("request_id").alias("last")).filter("a < last")
        stars.append(open_.join(first.select(key, "a"), key).select("a", F.col("request_id").alias("b")).filter("a < b"))
    edges = cut_lineage(stars[0].unionByName(stars[1]))
    if edges.isEmpty():
        return None
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return cut_lineage(connected_components(nodes, edges).withColumnRenamed("node", "request_id"))


def _in_order(requests: DataFrame, together: int) -> DataFrame:
    """(request_id, reason): requests of whole components, settled by request; the reason is null where accepted."""
    total = requests.select("request_id").count()
    slots = max(-(-total // together), 1)

    def settle(table: pa.Table) -> pa.Table:
        names, mails, reasons = set(), set(), []
        table = table.sort_by("request_id")
        for name, mail in zip(table["username"].to_pylist(), table["email"].to_pylist()):
            reason = USERNAME_TAKEN if name in names else EMAIL_TAKEN if mail in mails else None
            if reason is None:
                names.add(name)
                mails.add(mail)
            reasons.append(reason)
        return pa.table({"request_id": table["request_id"], "reason": pa.array(reasons, pa.string())})

    kind = requests.schema["request_id"].dataType.simpleString()
    dealt = requests.select("request_id", "username", "email", F.pmod(F.xxhash64("component"), F.lit(slots)).alias("slot"))
    return dealt.groupBy("slot").applyInArrow(settle, f"request_id {kind}, reason string")


def _refuse(requests: DataFrame, reason: str) -> DataFrame:
    return requests.select("request_id", F.lit(reason).alias("reason"))


def _union(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def save_cards(cards: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new card rows, rejects) of the requests that ask to be saved.

    A card number may be stored once; the first request wins and missing
    numbers may repeat. Saved cards hold no name and no address.
    """
    wanted = requests.filter(F.col("save_card"))
    fields = ["email", "customer_id", "exp_month", "exp_year", "card_id", "user_id"]
    free = wanted.join(cards.select("card_number"), "card_number", "left_anti")
    firsts = free.filter(F.col("card_number").isNotNull()).groupBy("card_number").agg(
        F.min_by(F.struct("request_id", *fields), "request_id").alias("r")
    ).select("card_number", "r.*")
    unnumbered = free.filter(F.col("card_number").isNull()).select("card_number", "request_id", *fields)
    saved = firsts.unionByName(unnumbered)
    refused = wanted.join(saved.select("request_id"), "request_id", "left_anti")
    return saved, refused.select("request_id", F.lit(CARD_IN_USE).alias("reason"))


def normalise_card_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """A blank e-mail becomes the requester's own; month, year and cvc become numbers."""
    own = users.select(F.col("id").alias("requester_id"), F.col("email").alias("_own"))
    joined = requests.join(own, "requester_id", "left")
    numbers = {c: text.to_number(text.blank_to_null(c)) for c in ("exp_month", "exp_year", "cvc")}
    return joined.withColumns({"email": text.keep_if_blank("email", "_own"), **numbers}).drop("_own")


def card_email_mismatch(
    requests: DataFrame, known: DataFrame, last4: str = "slice"
) -> tuple[DataFrame, DataFrame]:
    """Refuse a card whose last four digits are known under another e-mail.

    ``known`` has (last4, email). Per last4 the least and greatest e-mail and
    the presence of a missing one decide, so no pairs are formed and the lookup
    has one row per four digits.
    """
    held = known.groupBy(F.col("last4").alias("_last4")).agg(
        F.min("email").alias("_least"), F.max("email").alias("_most"),
        F.max(F.col("email").isNull()).alias("_unnamed"),
    )
    held = cut_lineage(held)
    seen = requests.withColumn("_last4", text.last4("card_number", last4))
    joined = seen.join(sized(held, held.count(), 256), "_last4", "left")
    email = F.col("email")
    other = (F.col("_least") != email) | (F.col("_most") != email) | F.col("_unnamed")
    # a request without an e-mail differs from every named holder
    clash = F.when(email.isNull(), F.col("_least").isNotNull()).otherwise(F.coalesce(other, F.lit(False)))
    return _judged(joined.withColumn("_reason", F.when(clash, EMAIL_MISMATCH)), requests.columns, "request_id")


def card_details_mismatch(requests: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refuse a known customer's card unless last4, month and year all match.

    ``known`` has (email, last4, exp_month, exp_year, created); the newest
    customer of an e-mail counts.
    """
    newest = known.groupBy("email").agg(
        F.max_by(
            F.struct(F.col("last4").alias("k_last4"), F.col("exp_month").alias("k_month"),
                     F.col("exp_year").alias("k_year")),
            "created",
        ).alias("k")
    ).select("email", "k.*", F.lit(True).alias("_known"))
    same = (
        F.col("k_last4").eqNullSafe(text.last4("card_number", "right"))
        & F.col("k_month").eqNullSafe(F.col("exp_month"))
        & F.col("k_year").eqNullSafe(F.col("exp_year"))
    )
    # written out, so that the join can split an e-mail with very many requests
    judged = requests.join(cut_lineage(newest), "email", "left").withColumn(
        "_reason", F.when(F.col("_known") & ~same, CARD_MISMATCH)
    )
    return _judged(judged, requests.columns, "request_id")


def append_orders(
    charges: DataFrame, products: DataFrame, addresses: DataFrame, as_of: datetime
) -> DataFrame:
    """Order rows for charges (request_id, user_id, card_number, product_id, address_id)."""
    items = products.select(F.col("id").alias("product_id"), F.col("name").alias("_item"), F.col("price").alias("_price"))
    line = text.format_address("house_no", "landmark", "city", "state", "pin_code")
    places = addresses.select(F.col("id").alias("address_id"), F.col("name").alias("_name"), line.alias("_line"))
    joined = charges.join(items, "product_id").join(places, "address_id")
    return joined.select(
        "request_id", F.col("_name").alias("name"), F.col("_item").alias("ordered_item"),
        text.last4("card_number", "right").alias("card_number"), F.col("_line").alias("address"),
        F.lit(True).alias("paid_status"), F.lit(as_of).cast("timestamp").alias("paid_at"),
        F.col("_price").alias("total_price"), F.lit(False).alias("is_delivered"),
        F.lit("Not Delivered").alias("delivered_at"), "user_id",
        text.minor_units("_price").alias("charged_minor_units"),
    )


def set_delivery_status(
    orders: DataFrame, changes: DataFrame, as_of: str, order: str = "request_id"
) -> DataFrame:
    """``changes`` has (id, is_delivered); the shown date is ``as_of`` or "Not Delivered"."""
    shown = F.when(F.col("n_is_delivered"), text.display_date(F.lit(as_of))).otherwise("Not Delivered")
    new = {"is_delivered": F.col("n_is_delivered"), "delivered_at": shown}
    return _update(orders, latest_changes(changes, "id", order), "id", new)
