"""Grain-safe reduction: one row per unit (an order, an order and seller, ...)."""

from marketlens.functions.columns import money_sum
from pyspark.sql import functions as F

#: Under this name the schema says that a table has one row per order.
GRAIN = "marketlens.grain"

# How a value that repeats on every item row of an order becomes one value of the unit.
REPEATED = {
    "delivery_days": F.max,
    "delivery_delay_days": F.max,
    "average_review_score": F.max,
    "customer_state": F.max,
    "is_late_delivery": F.bool_or,
}


def orders_of(df):
    """The order-grain table of an order-item table: what the order-level analyses need.

    It takes the place of the items in those analyses, which then shuffle nothing by order.
    """
    reduced = reduce_to(
        df,
        ["order_id"],
        REPEATED,
        revenue=money_sum("item_price"),
        freight=money_sum("freight_value"),
    )
    return marked_as_orders(reduced)


def marked_as_orders(df):
    """A table that is known to have one row per order, with that noted at its order_id.

    The note is part of the schema: it is stored with the table and survives a selection. No
    table is taken for one at order grain because of the columns that it happens to have.
    """
    kept = dict(df.schema["order_id"].metadata)
    return df.withMetadata("order_id", {**kept, GRAIN: "order"})


def at_order_grain(df):
    return "order_id" in df.columns and df.schema["order_id"].metadata.get(GRAIN) == "order"


def reduce_to(df, keys, repeated=(), **measures):
    """One row per `keys`: the named repeated columns, plus further aggregates by name.

    A table of `orders_of` (see `marked_as_orders`) has one row per order already; its columns are
    only selected. Any other table is reduced, also a projection of items that has no item number.
    """
    if list(keys) == ["order_id"] and at_order_grain(df):
        return df.select("order_id", *repeated, *measures)
    aggregates = [REPEATED[name](name).alias(name) for name in repeated]
    aggregates += [expression.alias(name) for name, expression in measures.items()]
    return df.groupBy(*keys).agg(*aggregates)
