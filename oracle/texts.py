"""The texts, rules and codes of the published reports, stated for the check SQL."""

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
CLAIM_REASONS = {
    "SERVICE": "Late Delivery - GHG",
    "PRICING": "Price - GHG",
}
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
ETA_REASONS = (
    "order eta update",
    "delivery estimate confirmation",
    "diner requested cancel - order too late",
    "late delivery",
    "late order",
)
KEY_CITIES = (
    "New York CBSA Excluding Manhattan",
    "New York - Manhattan",
    "Chicago-Naperville-Elgin IL-IN-WI",
)
TRI_STATE_CSA = "New York-Newark - NY-NJ-CT-PA"
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
