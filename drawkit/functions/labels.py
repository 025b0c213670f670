"""display labels of status values, as literal maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels by kind of status.
LABELS = {
    "match": {"exists": "存在", "missing": "不存在", "candidate": "待复核", "unchecked": "未检查", "exempt": "免查"},
    "mode": {"all": "全部图纸", "manual": "手动指定总成图"},
    "extraction": {"ok": "正常", "review": "待复核", "failed": "提取失败"},
    "translation": {"translated": "已翻译", "cached": "缓存", "skipped": "无需翻译", "needs_review": "待复核", "failed": "失败", "missing": "未翻译"},
    "section": {"title": "标题栏", "tech": "技术要求", "extra": "全文补充"},
}


def label(kind: str, value: Column) -> Column:
    """The label of a value; a value without one stands for itself."""
    pairs = F.create_map(*map(F.lit, chain.from_iterable(LABELS[kind].items())))
    return F.coalesce(F.element_at(pairs, value), value)
