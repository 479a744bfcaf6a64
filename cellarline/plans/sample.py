"""Parameters that spread the given star tables over every band, segment and label."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from cellarline.config import DEFAULTS

AS_OF = dt.date(2001, 8, 1)
YEAR = 2000
YEARS = tuple(range(1995, 2002))
ACCOUNT, PERIOD = "1212", 3

CFG = replace(
    DEFAULTS,
    rfm=replace(DEFAULTS.rfm, high_money=2_000_000, mid_money=1_000_000),
    loyalty=replace(DEFAULTS.loyalty, vip_money=2_500_000, loyal_orders=10),
    mix=replace(
        DEFAULTS.mix,
        red=("ECONOMY",),
        white=("STANDARD",),
        sparkling=("PROMO", "ESPUMOS"),
        red_exact="ECONOMY",
        white_exact="STANDARD",
    ),
    expert=replace(
        DEFAULTS.expert, vip_money=100_000, vip_money_wide=200_000, whale_money=2_000_000, thin_margin=0.70
    ),
    origin=replace(
        DEFAULTS.origin, star_margin=71.6, good_margin=71.3, low_margin=71.0, bad_margin=71.2,
        star_revenue=20_000_000, mid_revenue=18_000_000,
    ),
    cost_bands=tuple(
        (limit, text) for limit, (_, text) in zip((555, 570, 585, None), DEFAULTS.cost_bands, strict=True)
    ),
    price_below=("500", "<S/ 500"),
    price_between=(
        ("500", "1499.99", "S/ 500-1500"),
        ("1500", "2999.99", "S/ 1500-3000"),
        ("3000", "6000", "S/ 3000-6000"),
    ),
    price_rest=">S/ 6000",
    retention_from=1995,
)
