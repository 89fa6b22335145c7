"""These must equal the published report definitions exactly.

They are data, not logic: result texts, match patterns, code lists and the named
areas that the two reports test for. Everything that interprets them is elsewhere.
"""

# Ordered (pattern, reason) rules that normalise a free-text reason.
# A pattern is a list of phrases separated by "|"; the first rule that matches wins.
REASON_RULES = (
    ("food temp|cold|quality_temp|temperature", "food temperature"),
    ("incorrect order|incorrect item|wrong order|incorrect_item", "incorrect order"),
    ("damaged", "food damaged"),
    ("missing", "missing item"),
    ("item removed", "item removed from order"),
    ("late", "late order"),
    ("menu error", "order or menu issue"),
    ("temporarily unavailable|unavailable", "out of item"),
    ("order not rec|missed delivery", "missed delivery"),
)

# Ordered (pattern, group) rules that classify a normalised reason.
GROUP_RULES = (
    (
        "missed delivery|order not rec|late|damaged|ghd driver|food temp|quality_temp|cold",
        "Logistics Issues",
    ),
    (
        "missing item|missing|incorrect_order|menu error|incorrect_item|missing_item|"
        "incorrect item|incorrect order|quality|special|problem with food|food poison|"
        "object in food|temporarily unavailable|out of item|item removed|foreign object",
        "Restaurant Issues",
    ),
    ("diner error|switch to delivery or pickup|change of plans", "Diner Issues"),
)

# Reasons of granted guarantee claims by claim type.
CLAIM_REASONS = {
    "SERVICE": "Late Delivery - GHG",
    "PRICING": "Price - GHG",
}

# Self-service cancellation codes, their reason and their group.
SELF_SERVICE_REASONS = {
    "DINER_PAYMENT_ISSUE": "Payment Issues",
    "DINER_CHOSE_WRONG_ADDRESS": "Delivery Information Incorrect",
    "DINER_CHOSE_WRONG_ORDER_ITEMS": "Ordered By Mistake",
    "DINER_DOES_NOT_WANT_LATE_ORDER": "Late Order",
    "DINER_DOES_NOT_WANT_THE_FOOD": "Change of Plans",
}
SELF_SERVICE_GROUPS = {
    "DINER_PAYMENT_ISSUE": "Diner Issues",
    "DINER_CHOSE_WRONG_ADDRESS": "Diner Issues",
    "DINER_CHOSE_WRONG_ORDER_ITEMS": "Diner Issues",
    "DINER_DOES_NOT_WANT_LATE_ORDER": "Logistics Issues",
    "DINER_DOES_NOT_WANT_THE_FOOD": "Diner Issues",
}

# Cancellations that never reached the restaurant.
NOT_RECEIVED_LIKE = "%restaurant did%nt receive%"
NOT_RECEIVED_GROUP = "Transmission Issues"
NOT_RECEIVED_REASON = "restaurant did not receive order"

# Marker texts.
NOT_MAPPED = "Not Mapped"
OTHER_GROUP = "Other"
NOT_GROUPED = "not grouped"
NO_CARE_COST = "orders with no care cost"
REDELIVERY_GROUP = "logistics issues"
REDELIVERY_REASON = "Missed Delivery"

# Reason texts that count as trouble with the promised time.
ETA_REASONS = (
    "order eta update",
    "delivery estimate confirmation",
    "diner requested cancel - order too late",
    "late delivery",
    "late order",
)

# Adjustment, claim, transaction and fulfilment codes.
REFUND_DIRECTION = "ADJUST_DOWN"
GRANTED = "GRANT"
SINGLE_REFUND = "PCI_SINGLE_REFUND"
SHOP_AND_PAY = "SHOP_AND_PAY"

# Named areas.
CA_PREFIX = "CA"
KEY_CITIES = (
    "New York CBSA Excluding Manhattan",
    "New York - Manhattan",
    "Chicago-Naperville-Elgin IL-IN-WI",
)
TRI_STATE_CSA = "New York-Newark - NY-NJ-CT-PA"

# Region ids of the flagged market.
FLAGGED_REGION_IDS = frozenset(
    {
        "92ecc187-d0ed-4b17-bcdb-7da84786f0ef",
        "71ba188f-e632-4e6c-8710-fa1b6b7a303e",
        "eea72701-225b-4f8c-a13d-b10798e7c89c",
        "d56fcd88-9b3f-47f9-a7a9-ac8cc8b15e89",
        "2c2aed8b-9f85-4666-873a-10f492b69dcb",
        "adad9d37-7a3b-46ab-9ca6-c0a354b107d6",
        "ac195f13-5f83-473e-b897-8c098c302699",
        "a213d9d3-78ac-4025-a9d3-6a00304f344c",
        "b2070f16-6d97-4c6e-9ce8-7ae581b4e87f",
        "f373b4d7-9e3e-4960-bd54-9122c51fc02f",
        "5d35d88c-fa24-488e-892c-b046ccfb9f61",
        "7bf6fde8-d453-4679-83bb-c67b737f12ed",
        "60fa2685-2463-48ba-b864-05384504ec2b",
        "504eb68a-9148-4b1f-bcff-941a7ba8f0e1",
        "a15298e0-4a9f-4f7d-aee5-507b7ed81651",
        "f138e5e9-d03e-4832-8f60-6eda4246c1aa",
        "afa226a3-f2e2-4d9b-8fa1-e228b8c7ed0d",
    }
)

# Documented value lists of report A's dimensions.
MARKETS = ("CA", "DCWP", "ROM")
REASON_GROUPS = (
    "orders with no care cost",
    "logistics issues",
    "transmission issues",
    "other",
    "not grouped",
    "diner issues",
    "restaurant issues",
)
ETA_FLAGS = ("ETA Issues", "Other")
