"""Domain knowledge and thresholds as data: nothing below is wired into an operator."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DomainPack:
    """Vocabularies and patterns of one product domain; all patterns are case-insensitive Java regular expressions.

    The defaults below are fixed values of the soap and body-care domain; another domain passes its own pack.
    """

    noise: str = r"平行進口(?:貨品|貨)?|原裝行貨|行貨|現貨|即日寄出|24小時出貨|開倉價|限時優惠|人氣熱選|店長推薦|回購率No\.?1|送禮首選|超值之選|新舊包裝隨機|包裝隨機|新年份|好評|(?:EXP|到期日|最佳使用期)\s*[:：]?\s*[\d/.年月\-]+|Parallel Import|Hot Sale|New!"
    gift: str = r"[（(\[【]?\s*(?:加?送|附|贈)\s*(?:起泡袋|皂網|皂碟|皂盒|試用裝|\d+\s*(?:g|ml|克)\s*(?:旅行裝|體驗裝|試用裝))[^)）\]】\s]*\s*[)）\]】]?"
    generic: str = r"天然|溫和|保濕|滋潤|清爽|控油|嫩膚|經典|手工|冷製|深層潔淨|無添加|全家適用|孕婦可用|系列|之選|配方|natural|gentle"
    non_brand: str = r"直送|百貨|專門店|代購|旗艦|商行|貿易|批發|雜貨|優選館"
    non_brand_exact: tuple[str, ...] = ("oem", "generic", "no brand", "n/a", "n.a.", "na", "-", "無", "無牌子", "其他", "未知", "同上", "見圖", "待補", "自家品牌", "???")
    units: dict[str, tuple[str, float]] = field(default_factory=lambda: {"kg": ("g", 1000.0), "公斤": ("g", 1000.0), "千克": ("g", 1000.0), "grams": ("g", 1.0), "gram": ("g", 1.0), "gr": ("g", 1.0), "g": ("g", 1.0), "公克": ("g", 1.0), "克": ("g", 1.0), "ml": ("ml", 1.0), "毫升": ("ml", 1.0), "cc": ("ml", 1.0), "公升": ("ml", 1000.0), "升": ("ml", 1000.0), "litre": ("ml", 1000.0), "l": ("ml", 1000.0), "oz": ("g", 28.3495), "安士": ("g", 28.3495), "盎司": ("g", 28.3495), "片": ("pc", 1.0), "枚": ("pc", 1.0), "張": ("pc", 1.0), "pcs": ("pc", 1.0), "pc": ("pc", 1.0)})
    forms: tuple[tuple[str, str], ...] = (
        ("accessory", "皂盒|皂網|皂碟|皂托|起泡袋"),
        ("soap_paper", "皂紙|紙皂|soap paper"),
        ("bath_salt_bomb", "浴鹽|泡澡鹽|入浴鹽|入浴劑|bath salt|bath bomb"),
        ("body_lotion", "身體乳|潤膚露|潤膚乳|body lotion"),
        ("laundry_soap", "洗衣皂|家事皂|去污皂|laundry soap"),
        ("shampoo_bar", "洗髮皂|髮皂|洗髮餅|shampoo bar"),
        ("body_wash", "沐浴露|沐浴乳|沐浴液|body wash|shower gel"),
        ("hand_wash", "洗手液|潔手液|洗手乳|hand wash"),
        ("soap_bar", "香皂|肥皂|番梘|香枧|石鹼|手工皂|soap|皂"),
    )
    origin_names: dict[str, str] = field(default_factory=lambda: {"中國香港": "香港", "臺灣": "台灣", "澳大利亞": "澳洲", "南韓": "韓國", "義大利": "意大利"})
    count_words: dict[str, int] = field(default_factory=lambda: {"一": 1, "單": 1, "兩": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十二": 12})


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the matching pipeline."""

    unit_tolerance: float = 0.10
    formulation_tolerance: float = 0.5
    top_k: int = 20
    min_cosine: float = 0.40
    max_global_df: float = 0.10
    min_brand_count: int = 2
    min_split_group: int = 3
    min_alternative_group: int = 4
    veto_support: int = 2
    low_df: int = 5
    sweep: tuple[float, ...] = (0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95, 0.98, 0.99)
    max_merge_rate: float = 0.025
    min_pack_invariance: float = 0.98
    overlap: float = 0.50
    folds: int = 5
    trees: int = 180
    depth: int = 3
    rate: float = 0.07
    nprobe: int | None = None


DEFAULT_PACK = DomainPack()
DEFAULTS = Thresholds()
