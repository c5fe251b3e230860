"""Layers that many readers share are stored by columns."""
from __future__ import annotations

from builders import SELLER, customer, item, order, payment

from stallkeeper.operators import scenario


def test_held_tables_are_read_by_columns(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1"), order("o2")])
    held = m.held("orders")
    assert held.orders.inputFiles() and held.orders.schema == m.orders.schema
    assert sorted(map(tuple, held.orders.collect()), key=repr) == sorted(map(tuple, m.orders.collect()), key=repr)


def test_scenarios_take_shared_layers(commerce):
    from stallkeeper.operators.customers import customer_order_base, observed_orders
    m = commerce(customers=[customer("c1"), customer("c2")], orders=[order("o1"), order("o2"), order("o3", "c2")], sellers=SELLER,
                 payments=[payment("o1", 10), payment("o2", 30), payment("o3", 5)], items=[item("o1"), item("o2")])
    base = customer_order_base(m)
    second = scenario.second_orders(observed_orders(m, "2018-12-31", base))
    assert scenario.scenario_repeat(m, "2018-12-31", base=base, second=second).collect() == scenario.scenario_repeat(
        m, "2018-12-31").collect()


def test_metric_register_copies_no_plain_table(commerce):
    from stallkeeper.operators import checks
    m = commerce(customers=[customer("c1")], orders=[order("o1")], items=[item("o1")], payments=[payment("o1", 10)])
    kept = checks._stored_model(m)
    assert kept.items is m.items and kept.customers is m.customers and kept.orders.inputFiles()
