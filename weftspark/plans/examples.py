"""A small spec that uses most of the language."""

from __future__ import annotations

from weftspark.plans.spec import Column, Dataset, Event, ForeignKey, Rule, Table

SHOP = Dataset(
    tables={
        "shops": Table(
            "shops", [Column("shop_id", "INT", False, role="primary_key"), Column("city"), Column("margin", "FLOAT")],
            "dimension", 40, ["shop_id"],
        ),
        "orders_x": Table(
            "orders_x",
            [Column("order_id", "INT", False, role="primary_key"), Column("shop_id", "INT", role="foreign_key", references="shops.shop_id"),
             Column("ts", "DATETIME"), Column("amount", "FLOAT"), Column("channel"), Column("gross", "FLOAT"), Column("spent_7d", "FLOAT")],
            "fact", 2000, ["order_id"], [ForeignKey("shop_id", "shops", "shop_id")],
        ),
    },
    rules=[
        Rule("shops", "city", provider={"name": "geo.city"}),
        Rule("shops", "margin", {"kind": "uniform", "low": 0.1, "high": 0.4}),
        Rule("orders_x", "ts", {"kind": "seasonal", "by": "month", "weights": {"May": 0.5, "June": 0.5}}),
        Rule("orders_x", "amount", {"kind": "lognormal", "mean": 3.0, "sigma": 0.6}),
        Rule("orders_x", "channel", {"kind": "categorical", "values": ["web", "store"], "probs": [0.7, 0.3]}),
        Rule("orders_x", "gross", {"kind": "derived", "expression": "amount * (1 + margin)"}),
        Rule("orders_x", "spent_7d", {"kind": "window", "expression": "sum(gross)", "order_by": "ts", "partition_by": ["shop_id"],
                                      "frame": {"kind": "RANGE", "preceding": "7d"}}),
    ],
    events=[Event("sale", "2021-05-10", "2021-05-20", [{"table": "orders_x", "column": "amount", "effect": "multiply", "value": 1.5}])],
    workload=[{"type": "group_by", "sql": "select channel, count(*) as n from orders_x group by channel"}],
    description="Shops and their orders.",
)
