"""Rows of the model tables, as dicts; what is not named is NULL."""
from __future__ import annotations


def order(oid, customer="c1", bought="2018-01-01 10:00:00", status="delivered", **more):
    return {"order_id": oid, "customer_id": customer, "order_status": status, "order_purchase_timestamp": bought,
            "order_estimated_delivery_date": "2018-02-01 00:00:00", **more}


def customer(cid, user=None, state="SP", city="sao paulo"):
    return {"customer_id": cid, "customer_unique_id": user or cid, "customer_zip_code_prefix": "01000",
            "customer_city": city, "customer_state": state}


def payment(oid, value, kind="credit_card", seq=1, installments=1):
    return {"order_id": oid, "payment_sequential": seq, "payment_type": kind, "payment_installments": installments,
            "payment_value": value}


def item(oid, product="p1", price=10, seq=1, freight=1):
    return {"order_id": oid, "order_item_id": seq, "product_id": product, "seller_id": "s1", "price": price,
            "freight_value": freight, "shipping_limit_date": "2018-01-10 00:00:00"}


def review(oid, score, rid="r1", made="2018-01-10 00:00:00", answered="2018-01-11 00:00:00", text=None):
    return {"review_id": rid, "order_id": oid, "review_score": score, "review_comment_message": text,
            "review_creation_date": made, "review_answer_timestamp": answered}


SELLER = [{"seller_id": "s1", "seller_zip_code_prefix": "01000", "seller_city": "x", "seller_state": "SP"}]
