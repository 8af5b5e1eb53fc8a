"""Grids of configurations: what a network can use of them, and whether they say what was meant."""

from __future__ import annotations

#: What the fit and the networks read of a configuration.
KNOWN = frozenset("windows channels residual squeeze padding pool embedding gate dropout augment hidden batch epochs rate warmup_steps min_delta patience without".split())


def expand_dropout(d: float) -> dict[str, float]:
    """The five places of a network that drop, from one rate."""
    # The share of the rate at each place.
    shares = {"spatial_dropout": 0.25, "embed_dropout": 0.0, "gate_dropout": 0.5, "head_dropout_1": 1.0, "head_dropout_2": 0.5}
    return {place: round(share * d, 4) for place, share in shares.items()}


def usable_padding(padding: str | None, windows: list[int], channels: list[int]) -> str:
    """The padding, or "same" where the windows are too small to lose a cell on each side at every layer.

    All windows have to be large enough for "valid"; for another padding the largest has to be.
    """
    if not padding:
        return "same"
    window = min(windows) if padding == "valid" else max(windows)
    return padding if window > 2 * len(channels) else "same"


def edits(a: str, b: str) -> int:
    """Least number of letters put in, taken out or exchanged that make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_grid(grid: list[dict], known: frozenset[str] = KNOWN) -> list[dict]:
    """The grid with padding its windows allow; refused if it is empty, names what nothing reads, or cannot be built.

    A name is taken for a misspelt one at up to two edits, if those are under a third of it.
    """
    if not grid:
        raise ValueError("the grid has no configuration")
    out = []
    for i, cfg in enumerate(grid):
        for name in sorted(set(cfg) - known):
            near = min(sorted(known - set(cfg)), key=lambda k: edits(name, k), default="")
            meant = f"; {near} is not given: was it meant?" if near and edits(name, near) <= min(2, 0.3 * max(len(name), len(near))) else ""
            raise ValueError(f"configuration {i + 1}: nothing reads {name}{meant}")
        windows, channels = cfg.get("windows"), cfg.get("channels", [8])
        if windows is not None:
            if not 1 <= len(windows) <= 2 or len(set(windows)) < len(windows) or any(w < 1 or w % 2 == 0 for w in windows):
                raise ValueError(f"configuration {i + 1}: windows are one or two different odd sizes, not {windows}")
            if not channels or min(channels) < 1:
                raise ValueError(f"configuration {i + 1}: channels are sizes from 1, not {channels}")
            cfg = cfg | {"padding": usable_padding(cfg.get("padding", "valid"), windows, channels)}
        if not 0 <= cfg.get("dropout", 0) < 1:
            raise ValueError(f"configuration {i + 1}: dropout is a share below 1, not {cfg['dropout']}")
        out.append(cfg)
    return out


def strips_supported(cfg: dict) -> list[bool]:
    """By branch, the small window first: whether convolving a whole strip equals convolving each patch of it.

    It does without padding, and with squeezed channels only if the branch ends in a mean over its cells.
    """
    valid = [cfg.get("padding", "valid") == "valid" and w >= 1 + 2 * len(cfg.get("channels", [8])) for w in sorted(cfg["windows"])]
    return [v and (not cfg.get("squeeze") or bool(cfg.get("pool"))) for v in valid]
