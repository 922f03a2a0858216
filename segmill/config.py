"""Nested settings: defaults, YAML files, and ``path.to.key=value`` overrides; on the driver only."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "features": {"axis_tol_deg": 2.0, "min_length_rel": 0.01, "length_ref": "diagonal"},
    "merge": {"enable": False, "off_tol": 1.0, "gap_max": 2.0},
    "orientation": {"bins": 40, "size": 64, "min_overlap": 0.05},
    "coarse": {"enabled": False, "bins": 64, "dist_tol": 12.0, "angle_tol": 6.0, "len_tol": 0.15, "relax_topk_rel": [0.1, 0.2, 0.4], "relax_hv_angle": [6.0, 8.0, 10.0], "min_long_segments": 4, "allow_flips": ["none", "x", "y"]},
    "refine": {"scale_max_dev_rel": 0.02, "trans_max_dev_px": 8.0, "quality_gate": {"enabled": True, "rmse_px": 12.0, "score_min": 0.15, "fallback_trans_max_dev_px": 25.0, "fallback_scale_max_dev_rel": 0.05, "fallback_max_iters": 60}},
    "verify": {"mode": "", "distmap_raster": 256, "distmap_samples": 16},
    "fit": {"patience": 60, "iters": 120, "keep": 40, "points": 1500, "sigma": 4.0, "hard": 12.0, "seed": 7},
    "select": {"pick_k": 5, "cap": 20, "diversity_rel": 0.1},
    "match": {"radius": 20.0, "neighbour_radius": 80.0, "tol_rel": 0.01, "max_cost": None, "neighbour_weight": 1.0},
    "svg": {"curve_tol": 0.25},
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any] | None) -> dict[str, Any]:
    """``base`` with ``over`` laid over it, mapping by mapping; neither is changed."""
    out = copy.deepcopy(dict(base))
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def load(path: str | None = None, overrides: Iterable[str] = ()) -> dict[str, Any]:
    """Defaults, then the YAML file, then the overrides."""
    import yaml

    out = merged(DEFAULTS, None)
    if path:
        with open(path, encoding="utf-8") as f:
            out = merged(out, yaml.safe_load(f) or {})
    for text in overrides:
        out = merged(out, override(text))
    return out


def override(text: str) -> dict[str, Any]:
    """``a.b=value`` as nested mappings; the value is read as YAML."""
    import yaml

    path, eq, value = text.partition("=")
    if not eq or not all(part.strip() for part in path.split(".")):
        raise ValueError(f"not path=value: {text!r}")
    out: Any = yaml.safe_load(value)
    for part in reversed(path.split(".")):
        out = {part.strip(): out}
    return out


def allowed_flips(values: str | Iterable[str]) -> list[str]:
    """Names of flips, trimmed, lower-cased and without repeats, in order."""
    names = [v.strip().lower() for v in (values.split(",") if isinstance(values, str) else values)]
    if bad := [v for v in names if v not in ("none", "x", "y")]:
        raise ValueError(f"unknown flips: {', '.join(bad)}")
    return list(dict.fromkeys(names))


def for_rasters(cfg: Mapping[str, Any]) -> dict[str, Any]:
    """Settings held down to what raster-made segments bear: few draws, coarse bins, no neighbours, one line."""
    out = merged(cfg, None)
    out["fit"]["iters"] = min(out["fit"]["iters"], 60)
    out["fit"]["points"] = min(out["fit"]["points"], 80)
    out["coarse"]["bins"] = min(out["coarse"]["bins"], 256)
    out["select"]["pick_k"] = min(out["select"]["pick_k"], 1)
    out["match"]["neighbour_weight"] = 0.0
    return out
