"""Layout arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN_ANGLE = 2.399963229728653
SEED_RADIUS, SEED_STEP = 80.0, 96.0
PHONE_WIDTH, DESKTOP_WIDTH = 390.0, 1440.0  # defaults of this library
OVERSCAN, TILE = 320.0, 2048.0


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def lerp(a, b, t):
    return a + (b - a) * t


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def seed(index: Column, radius: float = SEED_RADIUS, step: float = SEED_STEP) -> tuple[Column, Column]:
    """Place on the golden-angle spiral of the index-th node (from 0)."""
    angle, r = index * GOLDEN_ANGLE, F.lit(radius) + F.sqrt(index + 1) * step
    return F.cos(angle) * r, F.sin(angle) * r


def bubble(count: Column, width: Column) -> dict[str, Column]:
    """Diameter and label sizes of a branch bubble in a viewport of that width."""
    density = F.pow(clamp((F.log10(F.greatest(count, F.lit(10))) - 1) / 2, 0.0, 1.0), 1.8)
    wide = clamp((width - PHONE_WIDTH) / (DESKTOP_WIDTH - PHONE_WIDTH), 0.0, 1.0)
    diameter = js_round(lerp(lerp(F.lit(100.0), F.lit(132.0), density), lerp(F.lit(146.0), F.lit(236.0), density), wide))
    font = js_round(lerp(F.lit(13.0), F.lit(16.0), wide))
    return {"diameter": diameter, "label_font_size": font, "label_line_height": js_round(font * 1.14), "label_max_width": js_round(diameter * 0.68)}


def ring_slot(index: Column) -> dict[str, Column]:
    """Ring, slot and capacity of the index-th bubble: one in the middle, then 6 r on ring r."""
    ring = F.when(index == 0, 0).otherwise(F.ceil((F.sqrt(12.0 * index + 9) - 3) / 6)).cast("long")
    slot = F.when(index == 0, 0).otherwise(index - 1 - 3 * ring * (ring - 1)).cast("long")
    return {"ring": ring, "slot": slot, "capacity": F.when(ring == 0, 1).otherwise(6 * ring).cast("long")}


def world_bounds(x: Column, y: Column, width: Column, height: Column, zoom: Column, overscan: float = OVERSCAN, tile: float = TILE) -> dict[str, Column]:
    """World rectangle of a canvas, widened by the overscan and snapped outward to tiles."""
    scale = F.pow(F.lit(2.0), zoom)
    down = lambda v: F.floor(v / tile) * tile
    up = lambda v: F.ceil(v / tile) * tile
    w, h = width / scale / 2 + overscan, height / scale / 2 + overscan
    return {"x0": down(x - w), "x1": up(x + w), "y0": down(y - h), "y1": up(y + h)}


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def screen(x: Column, y: Column, target: tuple[float, float], zoom: float, width: float, height: float) -> tuple[Column, Column]:
    """Place on a canvas, whose middle shows `target`, of a point of the world."""
    scale = 2.0**zoom
    return (x - target[0]) * scale + width / 2, (y - target[1]) * scale + height / 2
