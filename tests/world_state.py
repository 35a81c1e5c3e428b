"""A map folded sweep by sweep in one process, from the definition; what the Spark jobs are held against."""

import numpy as np
import pandas as pd

RULES = {"n": "sum", "ng": "sum", "gsum": "sum", "gsq": "sum", "gw": "sum", "zmin": "min", "zmax": "max", "gmin": "min", "h3": "sum"}


def folded(sweeps, res=0.4, trust=20.0, reach=90.0, common=40, align=True):
    """Cells after sweeps of (points with x, y, wx, wy, wz, lab; sensor x; sensor y), and the drift of each."""
    cells, drifts = None, []
    for t, sx, sy in sweeps:
        t = t[t["x"] ** 2 + t["y"] ** 2 <= trust**2]
        g, z = t["lab"].isin((0, 1)), t["wz"]
        w = 1 / (0.02**2 + 0.005**2 * (t["x"] ** 2 + t["y"] ** 2))
        d = pd.DataFrame({"ix": np.floor(t["wx"] / res).astype("int64"), "iy": np.floor(t["wy"] / res).astype("int64"), "n": 1, "ng": g.astype("int64"), "gsum": z.where(g, 0.0), "gsq": (z * z).where(g, 0.0), "gw": w.where(g, 0.0), "zmin": z, "zmax": z, "gmin": z.where(g), "h3": (t["lab"] == 3).astype("int64")})
        new, dz = d.groupby(["ix", "iy"], as_index=False).agg(RULES), 0.0
        if cells is not None and align:
            both = cells[cells["ng"] >= 3].merge(new[new["ng"] >= 3], on=["ix", "iy"])
            m = float((both["gsum_x"] / both["ng_x"] - both["gsum_y"] / both["ng_y"]).median()) if len(both) >= common else 0.0
            dz = m if abs(m) <= 0.5 else 0.0
        new["gsq"] += 2 * dz * new["gsum"] + new["ng"] * dz * dz
        new["gsum"] += new["ng"] * dz
        for c in ("zmin", "zmax", "gmin"):
            new[c] += dz
        cells = pd.concat([cells, new], ignore_index=True).groupby(["ix", "iy"], as_index=False).agg(RULES)
        far = ((cells["ix"] + 0.5) * res - sx) ** 2 + ((cells["iy"] + 0.5) * res - sy) ** 2 > reach**2
        cells = cells[~far].reset_index(drop=True)
        drifts.append(dz)
    return cells, drifts
