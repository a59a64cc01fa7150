"""Fixed data model: transaction codes, categories, entities and the two node trees."""

from __future__ import annotations

# Transaction code -> ledger column position.
CODE_TO_COLUMN = {
    31: 3, 30: 4, 13: 5, 14: 6, 36: 7, 5: 8, 4: 9, 3: 10, 6: 11, 22: 12,
    24: 13, 9: 14, 8: 15, 7: 16, 11: 17, 1: 18, 0: 19, 32: 20, 28: 21, 34: 22,
    33: 23, 37: 24, 39: 25, 35: 26, 41: 27, 38: 28, 40: 29, 19: 30, 18: 31, 21: 32,
    20: 33, 17: 34, 23: 35, 42: 36, 16: 37, 27: 38, 26: 39, 25: 40, 29: 41, 43: 42,
}

# Ledger columns of each category pair or single category, and the total column.
SPLIT_GROUPS = {
    ("Ekspor", "Impor"): (8, 11, 22, 24, 25, 28, 29, 46),
    ("Tarik_ULN", "Bayar_ULN"): (9, 10),
    ("Investasi", "Repatriasi"): (12, 14, 15, 16, 17, 18, 19, 30, 31, 32, 33, 34, 35, 36, 44),
}
PLAIN_GROUPS = {
    "Remittance": (20, 21),
    "Trading": (38, 39, 40, 47),
    "Transaksi_Tanpa_Underlying": (41,),
    "Lainnya": (2, 3, 4, 5, 6, 7, 13, 23, 26, 27, 37, 42, 45),
}
TOTAL_COLUMN = 43

# Category names in report order.
CATEGORIES = (
    "Ekspor", "Impor", "Tarik_ULN", "Bayar_ULN", "Investasi", "Repatriasi",
    "Remittance", "Trading", "Transaksi_Tanpa_Underlying", "Lainnya",
)

ENTITIES = ("KORPORASI", "PTMN", "ASING", "INDIVIDU")


def column_groups() -> list[tuple[int, str, str]]:
    """(column, category when negative, category when positive)."""
    rows = [(c, neg, pos) for (neg, pos), cols in SPLIT_GROUPS.items() for c in cols]
    rows += [(c, cat, cat) for cat, cols in PLAIN_GROUPS.items() for c in cols]
    return sorted(rows)


def code_groups() -> list[tuple[int, int, str, str]]:
    """(code, column, negative category, positive category) for every mapped code."""
    by_col = {c: (neg, pos) for c, neg, pos in column_groups()}
    return [(code, col, *by_col[col]) for code, col in sorted(CODE_TO_COLUMN.items())]


# Leaves of the detailed tree, as (parent node, entities with sign, categories in child order).
# A node with a lumped last child lists that child's own leaves under "<parent>.<letter>".
_DIRECT = {
    "A.0": ((("KORPORASI", 1),), CATEGORIES),
    "A.1": ((("PTMN", 1),), ("Impor", "Repatriasi")),
    "A.2": ((("KORPORASI", 1), ("PTMN", -1)),
            ("Ekspor", "Transaksi_Tanpa_Underlying", "Investasi", "Impor", "Repatriasi")),
    "B": ((("INDIVIDU", 1),), ("Ekspor", "Transaksi_Tanpa_Underlying", "Impor")),
    "C": ((("ASING", 1),), ("Investasi", "Remittance", "Repatriasi", "Trading")),
}


def _leaf_terms() -> dict[str, list[tuple[str, str, int]]]:
    leaves = {}
    for parent, (ents, cats) in _DIRECT.items():
        for i, cat in enumerate(cats):
            leaves[f"{parent}.{chr(97 + i)}"] = [(e, cat, s) for e, s in ents]
        rest = [c for c in CATEGORIES if c not in cats]
        lump = f"{parent}.{chr(97 + len(cats))}"
        for i, cat in enumerate(rest):
            leaves[f"{lump}.{i + 1}"] = [(e, cat, s) for e, s in ents]
    return leaves


def _ancestors(leaf: str) -> list[str]:
    parts = leaf.split(".")
    up = [".".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)]
    if leaf.startswith("A.0"):
        return up[:-1]          # A.0 is a memo of A.1 + A.2 and must not be counted twice
    return up + ["D"]


def tree_full() -> dict[str, list[tuple[str, str, int]]]:
    """node -> signed (entity, category) terms of the 61-node tree."""
    out: dict[str, list] = {}
    for leaf, terms in _leaf_terms().items():
        for node in [leaf, *_ancestors(leaf)]:
            out.setdefault(node, []).extend(terms)
    return dict(sorted(out.items()))


def tree_simple() -> dict[str, list[tuple[str, str, int]]]:
    """The 24-node tree: no A.0 memo block, lumped nodes are leaves."""
    full = tree_full()
    return {n: t for n, t in full.items() if not n.startswith("A.0") and not n[-1].isdigit() or n in ("A.1", "A.2")}


def leaf_nodes(tree) -> list[str]:
    return [n for n in tree if n != "D" and not any(m.startswith(n + ".") for m in tree)]


def parent_of(node: str) -> str | None:
    if node == "D":
        return None
    return node.rsplit(".", 1)[0] if "." in node else "D"


def rollup_bridge(tree) -> list[tuple[str, str, int]]:
    """(leaf, ancestor or self, 1) pairs of a tree."""
    rows = []
    for leaf in leaf_nodes(tree):
        rows.append((leaf, leaf, 1))
        rows += [(leaf, a, 1) for a in _ancestors(leaf) if a in tree]
    return rows


def node_level(node: str) -> int:
    return node.count(".") + 1


def tree_edges(tree) -> list[tuple[str, str]]:
    """(parent, child) pairs that must add up exactly; A.0 stays outside A."""
    return [(parent_of(n), n) for n in tree if parent_of(n) in tree and n != "A.0"]


def merged_leaf(node: str) -> str:
    return MERGE_PAIRS.get(node, node)


# Leaves of the sub-entity folded into their corporate siblings.
MERGE_PAIRS = {"A.1.a": "A.2.d", "A.1.b": "A.2.e", "A.1.c": "A.2.f"}
