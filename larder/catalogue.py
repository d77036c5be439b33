"""The reference schema as data: 49 tables, their columns, keys and rules.

Spark does not enforce keys or CHECKs; ``operators.rules`` turns this catalogue into
violation-finding jobs. Column types follow one rule (SURVEY §1.2): ``VARCHAR2(n)`` /
``CHAR(n)`` -> string with a byte limit, ``NUMBER(5)`` -> int with 5 digits, money /
rating / duration ``NUMBER`` -> decimal(18,2), count / quantity ``NUMBER`` -> bigint,
``DATE`` -> date, ``TIMESTAMP`` -> timestamp without zone.

A column is a row (name, kind, width, nullable). Kinds: ``s`` text and ``c`` fixed char of at most ``width`` bytes,
``i`` NUMBER of ``width`` digits, ``m`` decimal, ``n`` bigint, ``d`` date, ``t`` timestamp.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The reference schema (table -> columns), in declaration order.
COLUMNS: dict[str, tuple[tuple[str, str, int | None, bool], ...]] = {
    "warehouse": (
        ("warehouse_id", "s", 16, False),
        ("warehouse_name", "s", 100, False),
        ("zip", "i", 5, False),
        ("state", "s", 50, False),
        ("city", "s", 100, False),
        ("capacity", "n", None, False),
    ),
    "mcdcustomers": (
        ("cus_id", "s", 16, False),
        ("cusEmail", "s", 100, False),
        ("cusDOB", "d", None, False),
        ("state", "s", 50, False),
        ("city", "s", 50, False),
        ("street", "s", 100, False),
        ("zip", "s", 10, False),
        ("firstname", "s", 50, False),
        ("lastname", "s", 50, False),
        ("contactNumber", "s", 15, False),
    ),
    "franchiseowners": (
        ("owner_id", "s", 16, False),
        ("lname", "s", 50, False),
        ("fname", "s", 50, False),
        ("owner_mail", "s", 100, False),
    ),
    "franchise": (
        ("franchise_id", "s", 16, False),
        ("contact_no", "s", 15, False),
        ("street", "s", 100, False),
        ("zipcode", "s", 10, False),
        ("city", "s", 50, False),
        ("seating_capacity", "n", None, False),
        ("franchise_since", "d", None, False),
        ("operating_hrs", "s", 50, False),
        ("owner_id", "s", 16, False),
    ),
    "suppliers": (
        ("supplier_id", "s", 16, False),
        ("supplier_name", "s", 100, False),
        ("email_address", "s", 100, False),
        ("zip", "i", 5, False),
        ("street", "s", 255, False),
        ("city", "s", 100, False),
        ("contact_number", "s", 15, False),
        ("rating", "m", None, False),
    ),
    "employee_training": (
        ("training_ID", "s", 16, False),
        ("number_enrolled", "n", None, False),
        ("training_name", "s", 100, False),
    ),
    "employees": (
        ("employee_ID", "s", 16, False),
        ("contact_number", "s", 15, False),
        ("emergency_contact_number", "s", 15, False),
        ("DateOfHire", "d", None, False),
        ("state", "s", 50, False),
        ("city", "s", 50, False),
        ("zip", "s", 10, False),
        ("street", "s", 100, False),
        ("franchise_ID", "s", 16, False),
    ),
    "suppliers_products": (
        ("supplier_ID", "s", 16, False),
        ("supplied_Products", "s", 255, False),
    ),
    "franchise_agreement": (
        ("franchise_id", "s", 16, False),
        ("owner_id", "s", 16, False),
        ("agreement_id", "s", 16, False),
        ("agreementdate", "d", None, False),
        ("term_start_date", "d", None, False),
        ("term_end_date", "d", None, False),
    ),
    "franchise_inventory": (
        ("inv_Id", "s", 16, False),
        ("inv_state", "s", 16, False),
        ("inv_zip", "s", 16, False),
        ("inv_street", "s", 16, False),
        ("franchise_id", "s", 16, False),
    ),
    "salary_details": (
        ("employee_ID", "s", 16, False),
        ("franchise_ID", "s", 16, False),
        ("bonus", "m", None, False),
        ("base_Salary", "m", None, False),
        ("pay_frequency", "s", 50, False),
    ),
    "managers": (
        ("employee_ID", "s", 16, False),
    ),
    "supervisor": (
        ("employee_ID", "s", 16, False),
    ),
    "distribution_centers": (
        ("center_ID", "s", 16, False),
        ("center_name", "s", 100, False),
        ("operating_hours", "s", 50, False),
        ("storage_capacity", "n", None, False),
        ("zip", "s", 10, False),
        ("state", "s", 50, False),
        ("city", "s", 50, False),
        ("street", "s", 100, False),
    ),
    "dc_inventory_items": (
        ("dcinventoryID", "s", 16, False),
        ("inventoryType", "s", 50, False),
        ("dcItem_Quantity", "n", None, False),
        ("dcItemName", "s", 100, False),
        ("center_ID", "s", 16, False),
    ),
    "distribution_centers_contact": (
        ("center_ID", "s", 16, False),
        ("contactinfo", "s", 100, False),
    ),
    "third_party_logistics": (
        ("TPL_ID", "s", 16, False),
        ("TPLname", "s", 100, False),
        ("contactinfo", "s", 255, False),
        ("hq_location", "s", 255, False),
        ("fleetsize", "n", None, False),
    ),
    "third_party_logistics_services": (
        ("TPL_ID", "s", 16, False),
        ("services_provided", "s", 255, False),
    ),
    "operated_by": (
        ("TPL_ID", "s", 16, False),
        ("center_ID", "s", 16, False),
    ),
    "non_perishable": (
        ("dcinventoryID", "s", 16, False),
        ("recyclable", "s", 3, True),
    ),
    "perishable": (
        ("dcinventoryID", "s", 16, False),
        ("expirationDate", "d", None, False),
    ),
    "perishable_storage": (
        ("dcinventoryID", "s", 16, False),
        ("storage_requirements", "s", 255, False),
    ),
    "menu_items": (
        ("mItemID", "s", 16, False),
        ("mItemName", "s", 100, False),
        ("mitemCalories", "n", None, False),
        ("mItemPrice", "m", None, False),
        ("mItemCategory", "s", 50, False),
    ),
    "prepares": (
        ("franchiseID", "s", 16, False),
        ("mItemID", "s", 16, False),
    ),
    "promotions": (
        ("promoID", "s", 16, False),
        ("promo_name", "s", 100, False),
        ("promo_validity", "d", None, False),
        ("promo_start_date", "d", None, False),
    ),
    "promo_offers": (
        ("promoID", "s", 16, False),
        ("promo_offers", "s", 255, False),
    ),
    "marketing_campaigns": (
        ("campaignID", "s", 16, False),
        ("validity", "d", None, False),
        ("campaign_type", "s", 50, False),
        ("budget_alloted", "m", None, False),
    ),
    "organised_promo": (
        ("campaign_id", "s", 16, False),
        ("promo_id", "s", 16, False),
    ),
    "conducted_campaigns": (
        ("franchise_id", "s", 16, False),
        ("campaign_id", "s", 16, False),
    ),
    "coupons": (
        ("coupon_code", "s", 50, False),
        ("minPurchase_amt", "m", None, False),
        ("usage_limit", "n", None, False),
        ("coupon_type", "s", 50, False),
        ("coupExpiry", "d", None, False),
        ("coupDiscount", "m", None, False),
    ),
    "avail_coupons": (
        ("promo_id", "s", 16, False),
        ("coupon_code", "s", 50, False),
    ),
    "customer_orders": (
        ("order_id", "s", 16, False),
        ("orderdate", "d", None, False),
        ("Paymentmethod", "s", 50, False),
        ("deliverymethod", "s", 50, False),
        ("totalamount", "m", None, False),
        ("franchise_id", "s", 16, False),
        ("cus_id", "s", 16, False),
    ),
    "lists": (
        ("order_id", "s", 16, False),
        ("mitemID", "s", 16, False),
    ),
    "cus_order_detail": (
        ("mitemID", "s", 16, True),
        ("order_id", "s", 16, False),
        ("ordquantity", "n", None, False),
        ("ordprice", "m", None, False),
    ),
    "customer_feedbacks": (
        ("feedbackID", "s", 16, False),
        ("feedback_date", "d", None, False),
        ("rating", "m", None, False),
        ("service_used", "s", 50, False),
    ),
    "feedback_info": (
        ("cus_id", "s", 16, False),
        ("order_id", "s", 16, False),
        ("feedbackID", "s", 16, False),
    ),
    "training_details": (
        ("training_ID", "s", 16, False),
        ("employee_ID", "s", 16, False),
        ("train_start_date", "d", None, False),
        ("train_end_date", "d", None, False),
        ("train_duration", "m", None, False),
        ("completion_status", "s", 50, False),
    ),
    "eshifts_details": (
        ("Employee_ID", "s", 16, False),
        ("shiftDate", "d", None, False),
        ("startTime", "t", None, False),
        ("endTime", "t", None, False),
        ("shiftDuration", "m", None, False),
    ),
    "shipment": (
        ("trackingID", "s", 16, False),
        ("DateShipped", "d", None, False),
        ("EstDeliveryDate", "d", None, False),
        ("DestState", "s", 50, False),
        ("DestZIP", "n", None, False),
        ("carrierName", "s", 100, False),
        ("ShippingCost", "m", None, False),
    ),
    "raw_materials": (
        ("material_Id", "s", 16, False),
        ("materialName", "s", 100, False),
        ("typeofMaterial", "s", 50, False),
        ("cold_storage", "c", 1, True),
        ("quantity", "n", None, False),
    ),
    "shipment_details": (
        ("Material_Id", "s", 16, False),
        ("trackingID", "s", 16, False),
    ),
    "purchase_order": (
        ("PONo", "s", 16, False),
        ("PODate", "d", None, False),
        ("PurcQty", "n", None, False),
        ("Material_Id", "s", 16, True),
    ),
    "orders_to_dc": (
        ("orderNo", "s", 16, False),
        ("orderDate", "d", None, False),
        ("orderTotal", "m", None, False),
        ("ordQty", "n", None, False),
        ("discount", "s", 16, True),
        ("center_ID", "s", 16, True),
        ("PONo", "s", 16, True),
    ),
    "owns": (
        ("supplier_ID", "s", 16, False),
        ("warehouse_id", "s", 16, False),
        ("material_ID", "s", 16, False),
    ),
    "can_supply": (
        ("center_ID", "s", 16, False),
        ("Material_Id", "s", 16, False),
    ),
    "crew_member": (
        ("employee_ID", "s", 16, False),
        ("supervisor_ID", "s", 16, True),
    ),
    "delivery_details": (
        ("Franchise_ID", "s", 16, False),
        ("trackingID", "s", 16, False),
        ("confirmationCode", "n", None, False),
        ("DeliveryDate", "d", None, True),
        ("DeliveryStatus", "s", 50, True),
        ("ReceiverName", "s", 100, True),
    ),
    "franchiseowner_phones": (
        ("owner_id", "s", 16, False),
        ("owner_phone", "s", 15, True),
    ),
    "inventory_details": (
        ("Material_Id", "s", 16, True),
        ("inv_Id", "s", 16, True),
        ("inv_qoh", "n", None, True),
        ("inv_reorder_level", "n", None, True),
        ("inv_stock_status", "s", 50, True),
    ),
}

# Primary keys (tables absent here have none).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "warehouse": ("warehouse_id",), "mcdcustomers": ("cus_id",), "franchiseowners": ("owner_id",),
    "franchise": ("franchise_id",), "suppliers": ("supplier_id",), "employee_training": ("training_ID",),
    "employees": ("employee_ID",), "suppliers_products": ("supplier_ID",), "franchise_agreement": ("agreement_id",),
    "franchise_inventory": ("inv_Id",), "salary_details": ("employee_ID", "franchise_ID"),
    "managers": ("employee_ID",), "supervisor": ("employee_ID",), "distribution_centers": ("center_ID",),
    "dc_inventory_items": ("dcinventoryID",), "distribution_centers_contact": ("center_ID",),
    "third_party_logistics": ("TPL_ID",), "third_party_logistics_services": ("TPL_ID",),
    "operated_by": ("TPL_ID", "center_ID"), "non_perishable": ("dcinventoryID",), "perishable": ("dcinventoryID",),
    "perishable_storage": ("dcinventoryID",), "menu_items": ("mItemID",), "prepares": ("franchiseID", "mItemID"),
    "promotions": ("promoID",), "promo_offers": ("promoID",), "marketing_campaigns": ("campaignID",),
    "organised_promo": ("campaign_id", "promo_id"), "coupons": ("coupon_code",), "customer_orders": ("order_id",),
    "lists": ("order_id", "mitemID"), "customer_feedbacks": ("feedbackID",),
    "training_details": ("employee_ID", "training_ID"), "eshifts_details": ("Employee_ID", "shiftDate"),
    "shipment": ("trackingID",), "raw_materials": ("material_Id",), "shipment_details": ("Material_Id", "trackingID"),
    "purchase_order": ("PONo",), "owns": ("supplier_ID", "warehouse_id", "material_ID"),
    "can_supply": ("center_ID", "Material_Id"), "crew_member": ("employee_ID",),
    "delivery_details": ("Franchise_ID", "trackingID", "confirmationCode"), "franchiseowner_phones": ("owner_id",),
}

# Foreign keys as (child table, child column, parent table, parent column).
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("franchise", "owner_id", "franchiseowners", "owner_id"),
    ("employees", "franchise_ID", "franchise", "franchise_id"),
    ("suppliers_products", "supplier_ID", "suppliers", "supplier_id"),
    ("franchise_agreement", "franchise_id", "franchise", "franchise_id"),
    ("franchise_agreement", "owner_id", "franchiseowners", "owner_id"),
    ("franchise_inventory", "franchise_id", "franchise", "franchise_id"),
    ("salary_details", "employee_ID", "employees", "employee_ID"),
    ("salary_details", "franchise_ID", "franchise", "franchise_id"),
    ("managers", "employee_ID", "employees", "employee_ID"),
    ("supervisor", "employee_ID", "employees", "employee_ID"),
    ("dc_inventory_items", "center_ID", "distribution_centers", "center_ID"),
    ("distribution_centers_contact", "center_ID", "distribution_centers", "center_ID"),
    ("third_party_logistics_services", "TPL_ID", "third_party_logistics", "TPL_ID"),
    ("operated_by", "TPL_ID", "third_party_logistics", "TPL_ID"),
    ("operated_by", "center_ID", "distribution_centers", "center_ID"),
    ("non_perishable", "dcinventoryID", "dc_inventory_items", "dcinventoryID"),
    ("perishable", "dcinventoryID", "dc_inventory_items", "dcinventoryID"),
    ("perishable_storage", "dcinventoryID", "dc_inventory_items", "dcinventoryID"),
    ("prepares", "franchiseID", "franchise", "franchise_id"),
    ("prepares", "mItemID", "menu_items", "mItemID"),
    ("promo_offers", "promoID", "promotions", "promoID"),
    ("organised_promo", "campaign_id", "marketing_campaigns", "campaignID"),
    ("organised_promo", "promo_id", "promotions", "promoID"),
    ("conducted_campaigns", "franchise_id", "franchise", "franchise_id"),
    ("conducted_campaigns", "campaign_id", "marketing_campaigns", "campaignID"),
    ("avail_coupons", "promo_id", "promotions", "promoID"),
    ("avail_coupons", "coupon_code", "coupons", "coupon_code"),
    ("customer_orders", "franchise_id", "franchise", "franchise_id"),
    ("customer_orders", "cus_id", "mcdcustomers", "cus_id"),
    ("lists", "order_id", "customer_orders", "order_id"),
    ("lists", "mitemID", "menu_items", "mItemID"),
    ("cus_order_detail", "mitemID", "menu_items", "mItemID"),
    ("cus_order_detail", "order_id", "customer_orders", "order_id"),
    ("feedback_info", "cus_id", "mcdcustomers", "cus_id"),
    ("feedback_info", "order_id", "customer_orders", "order_id"),
    ("feedback_info", "feedbackID", "customer_feedbacks", "feedbackID"),
    ("training_details", "employee_ID", "employees", "employee_ID"),
    ("training_details", "training_ID", "employee_training", "training_ID"),
    ("eshifts_details", "Employee_ID", "employees", "employee_ID"),
    ("shipment_details", "Material_Id", "raw_materials", "material_Id"),
    ("shipment_details", "trackingID", "shipment", "trackingID"),
    ("purchase_order", "Material_Id", "raw_materials", "material_Id"),
    ("orders_to_dc", "center_ID", "distribution_centers", "center_ID"),
    ("orders_to_dc", "PONo", "purchase_order", "PONo"),
    ("owns", "supplier_ID", "suppliers", "supplier_id"),
    ("owns", "warehouse_id", "warehouse", "warehouse_id"),
    ("owns", "material_ID", "raw_materials", "material_Id"),
    ("can_supply", "center_ID", "distribution_centers", "center_ID"),
    ("can_supply", "Material_Id", "raw_materials", "material_Id"),
    ("crew_member", "employee_ID", "employees", "employee_ID"),
    ("crew_member", "supervisor_ID", "supervisor", "employee_ID"),
    ("delivery_details", "Franchise_ID", "franchise", "franchise_id"),
    ("delivery_details", "trackingID", "shipment", "trackingID"),
    ("franchiseowner_phones", "owner_id", "franchiseowners", "owner_id"),
    ("inventory_details", "Material_Id", "raw_materials", "material_Id"),
    ("inventory_details", "inv_Id", "franchise_inventory", "inv_Id"),
)

# Prefix rules (LIKE 'XX%') as (table, column, prefix).
PREFIXES: tuple[tuple[str, str, str], ...] = (
    ("warehouse", "warehouse_id", "WA"), ("mcdcustomers", "cus_id", "MCDC"), ("franchiseowners", "owner_id", "FO"),
    ("franchise", "franchise_id", "FA"), ("suppliers", "supplier_id", "SU"),
    ("employee_training", "training_ID", "ETRN"), ("employees", "employee_ID", "EMP"),
    ("franchise_agreement", "agreement_id", "FAGR"), ("franchise_inventory", "inv_Id", "FINV"),
    ("salary_details", "employee_ID", "EMP"), ("salary_details", "franchise_ID", "FA"),
    ("managers", "employee_ID", "EMP"), ("supervisor", "employee_ID", "EMP"),
    ("distribution_centers", "center_ID", "DC"), ("dc_inventory_items", "dcinventoryID", "DCIN"),
    ("distribution_centers_contact", "center_ID", "DC"), ("third_party_logistics", "TPL_ID", "TPL"),
    ("third_party_logistics_services", "TPL_ID", "TPL"), ("operated_by", "TPL_ID", "TPL"),
    ("operated_by", "center_ID", "DC"), ("non_perishable", "dcinventoryID", "DCIN"),
    ("perishable", "dcinventoryID", "DCIN"), ("perishable_storage", "dcinventoryID", "DCIN"),
    ("menu_items", "mItemID", "MI"), ("prepares", "franchiseID", "FA"), ("prepares", "mItemID", "MI"),
    ("promotions", "promoID", "PR"), ("promo_offers", "promoID", "PR"), ("marketing_campaigns", "campaignID", "MC"),
    ("organised_promo", "campaign_id", "MC"), ("organised_promo", "promo_id", "PR"),
    ("conducted_campaigns", "franchise_id", "FA"), ("conducted_campaigns", "campaign_id", "MC"),
    ("avail_coupons", "promo_id", "PR"), ("customer_orders", "order_id", "CO"),
    ("cus_order_detail", "order_id", "CO"), ("customer_feedbacks", "feedbackID", "FB"),
    ("feedback_info", "cus_id", "MCDC"), ("feedback_info", "order_id", "CO"), ("feedback_info", "feedbackID", "FB"),
    ("eshifts_details", "Employee_ID", "EM"), ("shipment", "trackingID", "SPM"), ("raw_materials", "material_Id", "RM"),
    ("purchase_order", "PONo", "PO"), ("orders_to_dc", "orderNo", "OTD"),
)

# Value rules as (table, column, kind, arguments).
VALUE_RULES: tuple[tuple[str, str, str, tuple], ...] = (
    ("suppliers", "rating", "between", (0, 5)),
    ("employee_training", "number_enrolled", "min", (0,)),
    ("salary_details", "bonus", "min", (0,)),
    ("salary_details", "base_Salary", "min", (0,)),
    ("distribution_centers", "storage_capacity", "min", (0,)),
    ("dc_inventory_items", "dcItem_Quantity", "min", (0,)),
    ("third_party_logistics", "fleetsize", "min", (0,)),
    ("non_perishable", "recyclable", "in", ("YES", "NO")),
    ("menu_items", "mitemCalories", "min", (0,)),
    ("menu_items", "mItemPrice", "min", (0,)),
    ("marketing_campaigns", "budget_alloted", "min", (0,)),
    ("coupons", "minPurchase_amt", "min", (0,)),
    ("coupons", "usage_limit", "min", (0,)),
    ("coupons", "coupDiscount", "min", (0,)),
    ("customer_orders", "totalamount", "min", (0,)),
    ("cus_order_detail", "ordquantity", "min", (0,)),
    ("cus_order_detail", "ordprice", "min", (0,)),
    ("customer_feedbacks", "rating", "between", (1, 5)),
    ("training_details", "train_duration", "min", (0,)),
    ("eshifts_details", "shiftDuration", "min", (0,)),
    ("raw_materials", "cold_storage", "in", ("Y", "N")),
)

# UNIQUE rules on non-key columns as (table, column).
UNIQUES: tuple[tuple[str, str], ...] = (
    ("mcdcustomers", "cusEmail"), ("franchiseowners", "owner_mail"), ("suppliers", "email_address"),
)


@dataclass(frozen=True)
class Column:
    name: str
    kind: str          # s, c, i, m, n, d, t
    width: int | None  # byte limit of text, digits of i
    nullable: bool

    @property
    def spark_type(self) -> T.DataType:
        return {"s": T.StringType(), "c": T.StringType(), "i": T.IntegerType(), "m": T.DecimalType(18, 2),
                "n": T.LongType(), "d": T.DateType(), "t": T.TimestampNTZType()}[self.kind]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()      # (column, parent, parent column)
    prefixes: tuple[tuple[str, str], ...] = ()
    value_rules: tuple[tuple[str, str, tuple], ...] = ()
    uniques: tuple[str, ...] = field(default_factory=tuple)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, c.nullable and c.name not in self.key,
                                           metadata={"width": c.width} if c.width else {})
                             for c in self.columns])

    def column(self, name: str) -> Column:
        low = name.lower()
        return next(c for c in self.columns if c.name.lower() == low)


def _build() -> dict[str, Table]:
    out = {}
    for name, rows in COLUMNS.items():
        out[name] = Table(
            name=name,
            columns=tuple(Column(*row) for row in rows),
            key=PRIMARY_KEYS.get(name, ()),
            foreign_keys=tuple((c, p, pc) for t, c, p, pc in FOREIGN_KEYS if t == name),
            prefixes=tuple((c, p) for t, c, p in PREFIXES if t == name),
            value_rules=tuple((c, k, a) for t, c, k, a in VALUE_RULES if t == name),
            uniques=tuple(c for t, c in UNIQUES if t == name),
        )
    return out


CATALOGUE: dict[str, Table] = _build()
