"""Parameter and resource registry: one declaration drives sweeps, sampling, mapping and features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Param:
    name: str
    source: str | tuple[str, ...] | None
    default: float
    low: float = 0
    high: float = 0
    step: str | tuple[int, ...] = "linear"
    kind: str = "int"
    enabled: bool = True

    def values(self) -> Column:
        """Array column of the sweep values, in sweep order."""
        if isinstance(self.step, tuple):
            return F.array(*[F.lit(v) for v in self.step])
        if self.step == "linear":
            return F.sequence(F.lit(int(self.low)), F.lit(int(self.high)))
        if self.step == "base2":
            points, v = [], int(self.low)
            if v == 0:
                points, v = [0], 1
            while v <= self.high:
                points.append(v)
                v *= 2
            return F.array(*[F.lit(p) for p in points])
        raise ValueError(f"unknown step {self.step!r} of {self.name}")

    def size(self) -> int:
        if isinstance(self.step, tuple):
            return len(self.step)
        if self.step == "linear":
            return int(self.high) - int(self.low) + 1
        n, v = 0, int(self.low)
        if v == 0:
            n, v = 1, 1
        while v <= self.high:
            n, v = n + 1, v * 2
        return n


@dataclass(frozen=True)
class Resource:
    name: str
    params: tuple[str, ...]
    depends: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Registry:
    params: tuple[Param, ...]
    resources: tuple[Resource, ...]
    by_name: dict[str, Param] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {p.name: p for p in self.params})
        for r in self.resources:
            unknown = [p for p in r.params if p not in self.by_name]
            if unknown:
                raise ValueError(f"resource {r.name} names unknown params {unknown}")

    def enabled_params(self) -> list[Param]:
        return [p for p in self.params if p.enabled]

    def enabled_resources(self, latency_dependent: bool | None = None) -> list[Resource]:
        return [
            r for r in self.resources
            if r.enabled and (latency_dependent is None or bool(r.depends) == latency_dependent)
        ]

    def with_param(self, param: Param) -> "Registry":
        """A registry with one more (or a replaced) parameter."""
        kept = tuple(p for p in self.params if p.name != param.name)
        return Registry(kept + (param,), self.resources)

    def with_resource(self, resource: Resource) -> "Registry":
        kept = tuple(r for r in self.resources if r.name != resource.name)
        return Registry(self.params, kept + (resource,))


# Parameter ranges, defaults and the sweep columns they are read from.
PARAMS = (
    Param("rob_size", "rob_size", 128, 1, 1024),
    Param("commit_width", "commit_width", 4, 1, 12),
    Param("load_queue_size", "lq_entries", 64, 1, 256),
    Param("store_queue_size", "sq_entries", 64, 1, 256),
    Param("alu_issue_width", "int_reg_issue_width", 4, 1, 8),
    Param("alu_mult_div_issue_width", "int_mult_div_issue_width", 2, 1, 8),
    Param("fp_issue_width", "fp_reg_issue_width", 4, 1, 8),
    Param("fp_mult_div_issue_width", "fp_mult_div_issue_width", 2, 1, 8),
    Param("ls_issue_width", ("rdwr_port_issue_width", "read_port_issue_width"), 2, 1, 16),
    Param("num_ls_pipes", "rdwr_port_issue_width", 2, 1, 8),
    Param("num_load_pipes", "read_port_issue_width", 2, 1, 8),
    Param("fetch_width", "fetch_width", 4, 1, 12),
    Param("decode_width", "decode_width", 4, 1, 12),
    Param("rename_width", "rename_width", 4, 1, 12),
    Param("num_fetch_buffers", None, 4, 1, 8, "base2", enabled=False),
    Param("max_icache_fills", "max_icache_fills", 8, 1, 32),
    Param("branch_predictor", "branch_predictor", 0, 0, 1),
    Param("misprediction_percent", None, 0.05, 0.0, 1.0, kind="float"),
    Param("l1d_cache_kb", "l1d_size", 64, 16, 256, "base2"),
    Param("l1i_cache_kb", "l1i_size", 64, 16, 256, "base2"),
    Param("l2_cache_kb", "l2_size", 1024, 512, 4096, "base2"),
    Param("l1d_stride_prefetch", "stride_prefetcher_degree", 0, step=(0, 4)),
)

# Resources, the parameters they sweep and the latencies they need.
RESOURCES = (
    Resource("rob", ("rob_size",), ("exe",)),
    Resource("load_queue", ("load_queue_size",), ("exe",)),
    Resource("store_queue", ("store_queue_size",), ("exe",)),
    Resource("alu_issue", ("alu_issue_width",)),
    Resource("alu_mult_div_issue", ("alu_mult_div_issue_width",)),
    Resource("fp_issue", ("fp_issue_width",)),
    Resource("fp_mult_div_issue", ("fp_mult_div_issue_width",)),
    Resource("ls_issue", ("ls_issue_width",)),
    Resource("load_ls_pipes_lower", ("num_ls_pipes", "num_load_pipes")),
    Resource("load_ls_pipes_upper", ("num_ls_pipes", "num_load_pipes")),
    Resource("icache_fills", ("max_icache_fills",), ("fetch",)),
    Resource("fetch_buffers", ("num_fetch_buffers",), ("fetch",), enabled=False),
)

REGISTRY = Registry(PARAMS, RESOURCES)

# The search grid of the design-space study, in order.
SEARCH_GRID: dict[str, list] = {
    "int_reg_issue_width": list(range(1, 9)),
    "int_mult_div_issue_width": list(range(1, 9)),
    "fp_reg_issue_width": list(range(1, 9)),
    "fp_mult_div_issue_width": list(range(1, 9)),
    "read_port_issue_width": list(range(1, 9)),
    "rdwr_port_issue_width": list(range(1, 9)),
    "fetch_width": list(range(1, 13)),
    "decode_width": list(range(1, 13)),
    "rename_width": list(range(1, 13)),
    "commit_width": list(range(1, 13)),
    "rob_size": list(range(1, 1025)),
    "lq_entries": list(range(1, 257)),
    "sq_entries": list(range(1, 257)),
    "branch_predictor": ["local", "tage"],
    "l1d_size": ["16KiB", "32KiB", "64KiB", "128KiB", "256KiB"],
    "l1i_size": ["16KiB", "32KiB", "64KiB", "128KiB", "256KiB"],
    "l2_size": ["512KiB", "1MiB", "2MiB", "4MiB"],
    "max_icache_fills": list(range(1, 33)),
    "stride_prefetcher_degree": [0, 4],
}
FIXED_PARAMS = {"simd_unit_issue_width": 1}
CONFIG_COLUMNS = sorted([*SEARCH_GRID, *FIXED_PARAMS])

# The default configuration of the design-space study.
DEFAULT_CONFIG = {
    "int_reg_issue_width": 2, "int_mult_div_issue_width": 2, "fp_reg_issue_width": 2,
    "fp_mult_div_issue_width": 2, "read_port_issue_width": 2, "rdwr_port_issue_width": 2,
    "simd_unit_issue_width": 1, "fetch_width": 8, "decode_width": 8, "rename_width": 8,
    "commit_width": 8, "rob_size": 192, "lq_entries": 32, "sq_entries": 32,
    "branch_predictor": "local", "l1d_size": "32KiB", "l1i_size": "32KiB", "l2_size": "512KiB",
    "max_icache_fills": 4, "stride_prefetcher_degree": 4,
}
