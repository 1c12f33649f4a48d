"""Fixed values of the course platform that results depend on.

These are stated as they stand in the original application; they are parameters of the
operators (each can be overridden per call) and the defaults here are the fixed values.
"""

from __future__ import annotations

from decimal import Decimal

# --- fixed values -------------------------------------------------------------------
# Plan lengths in days by product; any other product has no end date (unlimited).
PLAN_DAYS = {"Essential": 30, "Extra": 90, "Deluxe": 365}
# Product excluded from sales charts unless asked for.
PARTNERSHIP_PRODUCT = "Partnership"
# Partner share of an attributed order.
PARTNER_COMMISSION_RATE = Decimal("0.20")
# Payouts: minimum amount and commission rate per method.
PAYOUT_MIN_AMOUNT = Decimal("500")
PAYOUT_COMMISSION = {"card": Decimal("0.02"), "usdt": Decimal("0.01"), "sbp": Decimal("0")}
PAYOUT_STATUSES = ("pending", "processing", "paid", "rejected")
PAYOUT_UPDATE_STATUSES = ("processing", "paid", "rejected")
ORDER_STATUSES = ("pending", "paid", "refunded")
APPLICATION_STATUSES = ("pending", "approved", "rejected")
USER_ROLES = ("user", "partner", "admin")
OTP_PURPOSES = ("verify_email", "login", "reset_password")
CHANGE_EMAIL_PREFIX = "change_email:"
COOPERATION_TYPE_DEFAULT = "partner"
# Material categories; the public catalogue shows all but 'updates'.
MATERIAL_CATEGORIES = ("maps", "assets", "extra_maps", "extra_lessons", "updates")
PUBLIC_MATERIAL_CATEGORIES = ("maps", "assets", "extra_maps", "extra_lessons")
# Partner slugs: lower-case letters, digits and '-', 3 to 32 characters.
SLUG_PATTERN = r"\A[a-z0-9-]{3,32}\z"
# Generated partner slugs: at most 28 characters, fallback when nothing is left.
GENERATED_SLUG_MAX = 28
GENERATED_SLUG_FALLBACK = "partner"
# Promo codes: default discount and the accepted range.
PROMO_DEFAULT_DISCOUNT = 10
PROMO_DISCOUNT_RANGE = (1, 100)
# Product classes on the partner purchases page, first match wins (substring, lower case).
PRODUCT_CLASSES = ("essential", "extra", "deluxe")
PRODUCT_CLASS_OTHER = "other"
# Sessions: refresh tokens kept per user.
KEEP_TOKENS = 5
# Lists and charts.
DEFAULT_PAGE_SIZE = 20
CHART_DEFAULT_DAYS = 14
# Request ceilings: (max requests, window).
RATE_LIMITS = {
    "global": (300, "15 minutes"),
    "auth": (20, "15 minutes"),
    "slug": (30, "1 minute"),
}
# Partner revenue series: period -> (bucket unit, look-back days or None for all time).
REVENUE_PERIODS = {"day": ("hour", 1), "week": ("day", 7), "month": ("day", 30)}
REVENUE_PERIOD_OTHER = ("month", None)
# Grant of course access: product of the zero-amount order.
GRANT_PRODUCT = "Essential"
