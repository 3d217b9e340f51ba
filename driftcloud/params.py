"""Parameters of the operators; the defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import ceil, pi, radians


@dataclass(frozen=True)
class Grid:
    """Spherical image: horizontal and vertical resolution and field of view, in radians."""

    h_res: float = radians(0.4)
    v_res: float = radians(1.26)
    phi_min: float = -pi
    phi_max: float = pi
    theta_min: float = -0.535
    theta_max: float = 0.186

    @property
    def width(self) -> int:
        return ceil((self.phi_max - self.phi_min) / self.h_res)

    @property
    def height(self) -> int:
        return ceil((self.theta_max - self.theta_min) / self.v_res)


#: For sparse fixtures: 2 by 5 degrees.
COARSE = Grid(h_res=radians(2.0), v_res=radians(5.0))


@dataclass(frozen=True)
class Adaptive:
    """A tolerance that grows with depth beyond a threshold, then is clamped."""

    enabled: bool = True
    threshold: float = 5.0
    slope: float = 0.01
    most: float = 0.5
    least: float = 0.05


@dataclass(frozen=True)
class Params:
    grid: Grid = field(default_factory=Grid)
    min_range: float = 2.5
    max_range: float = 50.0
    range_enabled: bool = True
    # coarse occlusion and vote
    epsilon: float = 0.1
    window_h: int = 2
    window_v: int = 1
    history: int = 15
    init_sweeps: int = 10
    vote: int = 4
    # detailed occlusion
    detail_epsilon: float = 0.1
    detail_h: float = radians(0.29)
    detail_v: float = radians(0.4)
    detail_adaptive: Adaptive = field(default_factory=Adaptive)
    parallel_sweeps: int = 2
    perpendicular_sweeps: int = 3
    candidate_cap: int | None = None
    # map consistency
    mcc_enabled: bool = True
    mcc_sweeps: int = 10
    mcc_include_current: bool = True
    mcc_h: float = radians(0.57)
    mcc_v: float = radians(1.72)
    mcc_forward: float = 1.0
    mcc_forward_adaptive: Adaptive = field(default_factory=lambda: Adaptive(True, 20.0, 0.07, 3.0, 0.1))
    mcc_backward: float = 0.3
    mcc_backward_adaptive: Adaptive = field(default_factory=lambda: Adaptive(True, 20.0, 0.03, 1.0, 0.05))
    mcc_threshold: float = 0.2
    mcc_interpolate: bool = True
    mcc_neighbours: int = 20
    mcc_triplets: int = 100
    static_source: str = "ground"  # or "labels": what earlier sweeps were found to be
    # ground plane
    ground_radius: float = 25.0
    ground_z_min: float = -2.84023
    ground_z_max: float = -0.84023
    ground_trials: int = 50
    ground_inlier: float = 0.3
    ground_distance: float = 0.3
    # refinement
    refine: str = "none"
    hull: str = "outer"
    cluster_epsilon: float = 0.7
    cluster_least: int = 5
    cluster_size: int | None = None  # points of the smallest cluster; as ``cluster_least`` if not given
    # ground truth
    speed_threshold: float = 1.0
    extrapolate_us: int = 750_000
    least_annotations: int = 1

    @property
    def look_back(self) -> int:
        """How many sweeps before a sweep its labels depend on."""
        mcc = self.mcc_sweeps - 1 if self.mcc_include_current else self.mcc_sweeps
        return max(self.frames, mcc, self.parallel_sweeps, self.perpendicular_sweeps)

    @property
    def frames(self) -> int:
        """Past sweeps that are looked at: the buffer holds ``init_sweeps`` beside the current one."""
        return min(self.history, self.init_sweeps)

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


#: Labels of a point.
DYNAMIC, OCCLUDED_BY, EMPTY, UNDETERMINED, GROUND = range(5)
