"""Thresholds, bands, patterns and label texts used by the operators.

Every operator takes ``cfg``; pass ``dataclasses.replace(DEFAULTS, ...)`` to change a value.
"""

from __future__ import annotations

from dataclasses import dataclass

# Texts that readers of the result tables match on. They must stay exactly as they are.
NO_ORIGIN = "Sin Origen"
NO_BRAND = "Sin Marca"
NO_TYPE = "Desconocido"
NOT_FOUND = "No encontrado"
TAG_HISTORY = "histórico"
TAG_FORECAST = "pronóstico"
TAG_FORECAST_PLAIN = "pronostico"
MONTHS_ES = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
VINTAGE_PATTERN = r"\s*(1[9]\d{2}|20[0-4]\d)\b"
DEFAULT_EXCHANGE_RATE = 3.75


@dataclass(frozen=True)
class RfmRules:
    """Six-segment rule. Texts and defaults are fixed values."""

    hot_days: int = 60
    warm_days: int = 90
    cold_days: int = 180
    high_orders: int = 10
    mid_orders: int = 5
    high_money: int = 50_000
    mid_money: int = 20_000
    champions: str = "Champions"
    loyal: str = "Leales"
    promising: str = "Prometedores"
    at_risk: str = "En Riesgo"
    lost: str = "Perdidos"
    developing: str = "En Desarrollo"


@dataclass(frozen=True)
class LoyaltyRules:
    """Five-way label of the customer ranking. Texts and defaults are fixed values."""

    vip_days: int = 60
    vip_money: int = 150_000
    loyal_days: int = 90
    loyal_orders: int = 80
    active_days: int = 120
    risk_days: int = 180
    vip: str = "🏆 VIP"
    loyal: str = "⭐ Leal"
    active: str = "🟢 Activo"
    at_risk: str = "🟡 En riesgo"
    inactive: str = "🔴 Inactivo"


@dataclass(frozen=True)
class MixRules:
    """Upper-case substrings that mark the three wine kinds, and the mix texts (fixed values)."""

    red: tuple[str, ...] = ("TINTO",)
    white: tuple[str, ...] = ("BLANCO",)
    sparkling: tuple[str, ...] = ("ESPUMOS", "ESPUMANTE", "CAVA", "CHAMPAGNE")
    # The cross-sell count matches these two with their case.
    red_exact: str = "Tinto"
    white_exact: str = "Blanco"
    only_red: str = "Solo Tinto"
    red_white: str = "Tinto+Blanco"
    red_sparkling: str = "Tinto+Espumoso"
    full: str = "Full Portfolio"
    no_red: str = "Blanco/Esp s.Tinto"
    other: str = "Otros"


@dataclass(frozen=True)
class ExpertRules:
    """Strategic customer groups: (text, action, priority) in report order. Fixed values."""

    vip_money: int = 10_000
    vip_money_wide: int = 20_000
    vip_orders: int = 5
    whale_money: int = 10_000
    whale_days: int = 180
    drift_days: tuple[int, int] = (90, 180)
    mono_orders: int = 3
    thin_margin: float = 0.20
    vip: tuple[str, str, str] = (
        "VIPs en Fuga (Inactivos {year})",
        "Llamada de Gerencia + Invitación a cata privada de nuevas añadas",
        "Alta",
    )
    whale: tuple[str, str, str] = (
        "Ballenas Perdidas (Histórico >10K)",
        "Visita comercial presencial con oferta de relanzamiento de cuenta",
        "Alta",
    )
    drift: tuple[str, str, str] = (
        "Deriva de Frecuencia",
        'Email "Te extrañamos" con recomendación personalizada basada en historial',
        "Media",
    )
    mono: tuple[str, str, str] = (
        "Potencial Cross-sell (Monocultivo)",
        "Envío de muestras de otras categorías (Blancos/Espumosos) + cupón combo",
        "Media",
    )
    once: tuple[str, str, str] = (
        "Reactivación (1 sola compra)",
        "Descuento en 2da compra + Guía de maridaje digital interactiva",
        "Normal",
    )
    margin: tuple[str, str, str] = (
        "Optimización de Margen",
        "Asesoría para migración guiada a etiquetas Premium de mayor rentabilidad",
        "Media",
    )


@dataclass(frozen=True)
class OriginRules:
    """Action per origin country: margin % and revenue limits, texts (fixed values)."""

    star: str = "Estrella principal"
    consolidate: str = "Consolidar"
    review: str = "Revisar precios"
    boost: str = "Ampliar impulso"
    widen: str = "Ampliar portafolio"
    restructure: str = "Reestructurar"
    keep: str = "Mantener"
    star_margin: float = 40
    good_margin: float = 30
    low_margin: float = 20
    bad_margin: float = 15
    star_revenue: float = 100_000
    mid_revenue: float = 50_000
    few_products: int = 5


@dataclass(frozen=True)
class Settings:
    rfm: RfmRules = RfmRules()
    loyalty: LoyaltyRules = LoyaltyRules()
    mix: MixRules = MixRules()
    expert: ExpertRules = ExpertRules()
    origin: OriginRules = OriginRules()

    # Unit cost bands: (upper bound, exclusive; text). None closes the list. Fixed values.
    cost_bands: tuple[tuple[float | None, str], ...] = (
        (75, "1. Económico (<US$20)"),
        (185, "2. Medio (US$20–50)"),
        (480, "3. Premium (US$50–130)"),
        (None, "4. Ultra Premium (>US$130)"),
    )
    # Unit price bands: text and limits as decimal text. The first is "below"; the inner ones are closed
    # on both sides, so a price such as 149.995 lies in a gap and falls to the last band. Fixed values.
    price_below: tuple[str, str] = ("69", "<S/ 69")
    price_between: tuple[tuple[str, str, str], ...] = (
        ("69", "149.99", "S/ 69-150"),
        ("150", "299.99", "S/ 150-300"),
        ("300", "600", "S/ 300-600"),
    )
    price_rest: str = ">S/ 600"

    # Orders per customer: (last count of the range, text). Fixed values.
    frequency_bands: tuple[tuple[int | None, str], ...] = (
        (1, "1 compra"),
        (3, "2-3"),
        (10, "4-10"),
        (50, "11-50"),
        (None, ">50"),
    )
    # Seasonal level: (ratio to exceed, text). Fixed values.
    season_levels: tuple[tuple[float, str], ...] = ((1.15, "Muy alto"), (1.00, "Alto"), (0.85, "Normal"))
    season_rest: str = "Bajo"

    brand_min_revenue: int = 50_000
    brand_limit: int = 8
    fit_brands: int = 15
    retention_from: int = 2022
    min_series_months: int = 6
    horizon: int = 3
    season_length: int = 12


DEFAULTS = Settings()
