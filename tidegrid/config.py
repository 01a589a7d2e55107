"""Constants of the analyses, passed explicitly: executors do not see the driver's environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Rates in Hz, the breathing band in Hz, map and clip sizes, split settings.
    fs: float = 30.0
    fs_train: float = 15.0
    low: float = 0.1
    high: float = 0.5
    grid: int = 8
    crop: int = 128
    box_scale: float = 1.5
    clip: int = 300
    tau: float = 0.1
    warp_minus: int = 30
    warp_plus: int = 60
    ratios: tuple[float, float, float] = (0.7, 0.1, 0.2)
    seed: int = 42
    val_fraction: float = 0.10
    val_seed: int = 20240501


DEFAULT = EngineConfig()
