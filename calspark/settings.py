"""Run and plane settings as frozen dataclasses, with overlays and their documentation."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace


def opt(default, text: str, low=None, high=None):
    """A field with its description and, where it has one, its range."""
    made = (lambda: list(default)) if isinstance(default, list) else None
    meta = {"text": text, "low": low, "high": high}
    return field(default_factory=made, metadata=meta) if made else field(default=default, metadata=meta)


@dataclass(frozen=True)
class Recording:
    """What was recorded, and how pages map to planes and channels."""

    data_path: list = opt([], "folders with the files of the recording")
    file_list: list = opt([], "files to read, in order; empty: all that match")
    subfolders: list = opt([], "subfolders of the first folder to read")
    look_one_level_down: bool = opt(False, "also read the folders below")
    input_format: str = opt("tif", "tif, raw, npy, xml or the name of an installed reader")
    nplanes: int = opt(1, "planes visited in turn", 1)
    nrois: int = opt(1, "fields of view in a page", 1)
    nchannels: int = opt(1, "channels, 1 or 2", 1, 2)
    swap_order: bool = opt(False, "planes change faster than channels")
    functional_chan: int = opt(1, "channel that regions are found in, from 1", 1, 2)
    lines: list = opt([], "image lines of every field of view")
    dy: list = opt([], "row of every field on the canvas")
    dx: list = opt([], "column of every field on the canvas")
    ignore_flyback: list = opt([], "planes to leave out")
    bruker_bidirectional: bool = opt(False, "planes are visited up and down")
    batch_size: int = opt(500, "frames a batch where batches matter", 1)


@dataclass(frozen=True)
class Run:
    do_registration: int = opt(1, "0 no, 1 unless it was done, 2 always", 0, 2)
    do_regmetrics: bool = opt(True, "measure registration by principal components")
    do_detection: bool = opt(True, "find regions")
    do_deconvolution: bool = opt(True, "estimate spikes")


@dataclass(frozen=True)
class IO:
    combined: bool = opt(True, "put the planes on one canvas")


@dataclass(frozen=True)
class Registration:
    align_by_chan2: bool = opt(False, "find shifts in the second channel")
    nimg_init: int = opt(400, "frames for the reference", 1)
    maxregshift: float = opt(0.1, "largest rigid shift as a share of the shorter side", 0.0, 1.0)
    do_bidiphase: bool = opt(False, "estimate the offset between line directions")
    bidiphase: int = opt(0, "offset to use instead")
    batch_size: int = opt(100, "frames a batch for temporal smoothing", 1)
    nonrigid: bool = opt(True, "also register blocks")
    maxregshiftNR: int = opt(5, "largest shift of a block", 0)
    block_size: tuple = opt((128, 128), "pixels of a block")
    smooth_sigma_time: float = opt(0.0, "frames over which correlation maps are smoothed", 0.0)
    smooth_sigma: float = opt(1.15, "pixels over which the reference is smoothed", 0.0)
    spatial_taper: float = opt(3.45, "pixels over which edges fade", 0.0)
    th_badframes: float = opt(1.0, "larger: fewer frames are bad", 0.0)
    norm_frames: bool = opt(True, "clip frames to the reference's percentiles")
    snr_thresh: float = opt(1.2, "peak ratio under which blocks are smoothed", 0.0)
    subpixel: int = opt(10, "steps a pixel", 1)
    two_step_registration: bool = opt(False, "register twice, the second time to the registered mean")


@dataclass(frozen=True)
class SparsePursuit:
    highpass_neuropil: int = opt(25, "pixels of the surround that is taken out", 1)
    max_ROIs: int = opt(5000, "most regions a plane", 0)
    spatial_scale: int = opt(0, "0: estimated, else 1 to 4", 0, 4)
    active_percentile: float = opt(0.0, "percentile of activity that counts as active", 0.0, 100.0)


@dataclass(frozen=True)
class ComponentPursuit:
    connected: bool = opt(True, "keep the connected part of a region")
    max_iterations: int = opt(20, "rounds", 1)
    smooth_masks: bool = opt(False, "smooth masks")


@dataclass(frozen=True)
class Detection:
    algorithm: str = opt("sparse", "sparse or components")
    denoise: bool = opt(False, "rebuild the movie from block components first")
    block_size: tuple = opt((64, 64), "pixels of a block for denoising")
    nbins: int = opt(5000, "most bins", 1)
    bin_size: int = opt(0, "frames a bin; 0: from tau and fs", 0)
    highpass_time: int = opt(100, "bins of the running mean that is taken out", 1)
    threshold_scaling: float = opt(1.0, "larger: fewer regions", 0.0)
    npix_norm_min: float = opt(0.0, "least size relative to the median")
    npix_norm_max: float = opt(100.0, "largest size relative to the median")
    max_overlap: float = opt(0.75, "largest share of shared pixels", 0.0, 1.0)
    soma_crop: bool = opt(True, "leave dendrites out of shape statistics")
    chan2_threshold: float = opt(0.25, "share above which a region is in the second channel", 0.0, 1.0)
    inverted_activity: bool = opt(False, "activity darkens")
    tile: int = opt(128, "side of the tiles that a larger plane is searched in, a multiple of 16; 0: whole planes", 0)
    sparse: SparsePursuit = field(default_factory=SparsePursuit)
    components: ComponentPursuit = field(default_factory=ComponentPursuit)


@dataclass(frozen=True)
class Classification:
    classifier_path: str = opt("", "a saved classifier")
    preclassify: float = opt(0.0, "probability under which regions go before extraction", 0.0, 1.0)


@dataclass(frozen=True)
class Extraction:
    snr_threshold: float = opt(0.0, "traces of lower SNR go; not positive: none", high=1.0)
    neuropil_extract: bool = opt(True, "also extract the surroundings")
    neuropil_coefficient: float = opt(0.7, "share of the surroundings that is subtracted", 0.0)
    inner_neuropil_radius: int = opt(2, "pixels left free around a region", 0)
    min_neuropil_pixels: int = opt(350, "pixels of the surroundings", 0)
    lam_percentile: float = opt(50.0, "local percentile under which pixels are no cell pixels", 0.0, 100.0)
    allow_overlap: bool = opt(False, "extract from shared pixels")
    circular_neuropil: bool = opt(False, "grow the shape, not its box")


@dataclass(frozen=True)
class Baseline:
    baseline: str = opt("maximin", "maximin, constant, prctile or none")
    win_baseline: float = opt(60.0, "seconds of the rolling extremes", 0.0)
    sig_baseline: float = opt(10.0, "frames over which traces are smoothed", 0.0)
    prctile_baseline: float = opt(8.0, "percentile", 0.0, 100.0)


@dataclass(frozen=True)
class Settings:
    tau: float = opt(1.0, "decay of the indicator in seconds", 0.0)
    fs: float = opt(10.0, "frames a second", 0.0)
    diameter: tuple = opt((12.0, 12.0), "pixels of a cell")
    run: Run = field(default_factory=Run)
    io: IO = field(default_factory=IO)
    registration: Registration = field(default_factory=Registration)
    detection: Detection = field(default_factory=Detection)
    classification: Classification = field(default_factory=Classification)
    extraction: Extraction = field(default_factory=Extraction)
    dcnv_preprocess: Baseline = field(default_factory=Baseline)


def overlay(base, values: dict):
    """``base`` with the values of a nested dict over it, checked; unknown names raise."""
    known = {f.name: f for f in fields(base)}
    changes = {}
    for name, value in values.items():
        if name not in known:
            raise KeyError(f"{type(base).__name__} has no setting {name!r}")
        old, meta = getattr(base, name), known[name].metadata
        if is_dataclass(old):
            value = overlay(old, value)
        elif isinstance(old, tuple):
            value = tuple(value) if isinstance(value, (list, tuple)) else (value,) * len(old)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            if meta.get("low") is not None and value < meta["low"] or meta.get("high") is not None and value > meta["high"]:
                raise ValueError(f"{name} = {value} is outside {meta['low']} .. {meta['high']}")
        changes[name] = value
    return replace(base, **changes)


def _flat(base, prefix=()):
    for f in fields(base):
        value = getattr(base, f.name)
        if is_dataclass(value):
            yield from _flat(value, (*prefix, f.name))
        else:
            yield (*prefix, f.name), value, f.metadata


#: Names of older flat settings that changed.
RENAMED = {"roidetect": ("run", "do_detection"), "spikedetect": ("run", "do_deconvolution"), "neucoeff": ("extraction", "neuropil_coefficient"), "high_pass": ("detection", "highpass_time")}


def from_flat(values: dict) -> tuple[Recording, Settings]:
    """Recording and settings from one flat dict of an older run; names that neither knows are left out."""
    where: dict[str, tuple] = {}
    for path, _, _ in _flat(Settings()):
        where.setdefault(path[-1], path)
    where |= RENAMED
    nested: dict = {}
    record = {f.name for f in fields(Recording)}
    for name, value in values.items():
        if name in where:
            at = nested
            for part in where[name][:-1]:
                at = at.setdefault(part, {})
            at[where[name][-1]] = value
    return overlay(Recording(), {k: v for k, v in values.items() if k in record}), overlay(Settings(), nested)


def load(path: str) -> dict:
    """A nested dict of settings from a JSON file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


#: Where a user keeps settings of their own, laid over the defaults.
USER_SETTINGS = "~/.calspark/settings.json"


def user_settings(path: str = USER_SETTINGS) -> Settings:
    """The defaults with the user's own settings over them, where there are any."""
    path = os.path.expanduser(path)
    return overlay(Settings(), load(path)) if os.path.exists(path) else Settings()


def save_folder(record: Recording, root: str = "", name: str = "calspark") -> str:
    """Where the tables of a recording go: below ``root``, else below its first folder."""
    if not root and not record.data_path:
        raise ValueError("a recording without folders needs a folder for its tables")
    return f"{(root or record.data_path[0]).rstrip('/')}/{name}"


def markdown(base=None) -> str:
    """The settings as a table."""
    rows = ["| setting | default | meaning |", "|---|---|---|"]
    rows += [f"| {'.'.join(path)} | {value} | {meta['text']} |" for path, value, meta in _flat(base or Settings())]
    return "\n".join(rows)
