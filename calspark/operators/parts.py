"""Sparse pursuit over parts of a plane's frames at once, with the regions of the search on the whole plane.

A task holds one stretch of a plane's frames. All that the search asks of a movie are sums over frames, which the
tasks of a barrier stage add up among themselves: squared steps, energies, frames in which a region is active. So every
task sees the same maps and takes the same places, and only images travel. Planes come one after the other, each
over all tasks: a task's memory is a plane's frames over the number of tasks.
"""

from __future__ import annotations

import os
import socket
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener
from multiprocessing.reduction import ForkingPickler

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from calspark.operators import pursuit
from calspark.operators.pursuit import SparseSettings
from calspark.operators.tiles import high_passed

#: Values of a plane, frames x pixels, that one task searches alone.
ALONE = 4_000_000
#: Frames taken at a time.
FRAMES = 256

class Part:
    """A stretch of a plane's frames; ``exchange`` gives what every part's task hands in, in the order of the frames."""

    def __init__(self, movie: np.ndarray, height: int, width: int, settings: SparseSettings, highpass: int, exchange: _Tasks):
        self.settings, self.exchange = settings, exchange
        self.work = high_passed(movie.reshape(-1, height, width), highpass)
        last = exchange((len(self.work), self.work[-1].copy() if len(self.work) else None))
        self.frames = sum(n for n, _ in last)
        self.before = sum(n for n, _ in last[: exchange.rank])
        edge = next((x for n, x in reversed(last[: exchange.rank]) if n), None)
        steps = np.zeros((height, width))
        for at in self._blocks():
            x = self.work[at] if edge is None else np.concatenate([edge[None], self.work[at]])
            steps += (np.diff(x, axis=0) ** 2).sum(0)
            edge = self.work[at][-1]
        self.sd = np.maximum(np.sqrt(self._sum(steps) / self.frames), 1e-10)
        highest = [np.full(r.shape[1:], -np.inf) for r in pursuit.pyramid(np.zeros((1, height, width)))]
        for at in self._blocks():
            self.work[at] = pursuit.without_surround(self.work[at] / self.sd, settings.highpass_neuropil)
            highest = [np.maximum(h, r.max(0)) for h, r in zip(highest, pursuit.pyramid(self.work[at]))]
        highest = [np.max(h, axis=0) for h in zip(*exchange(highest))]
        scale = pursuit.estimate_scale(highest, settings.spatial_scale)
        self.threshold, self.stop = pursuit.thresholds(settings, scale, self.frames)
        self.squares = [np.zeros(h.shape) for h in highest]
        for at in self._blocks():
            self.squares = [s + q for s, q in zip(self.squares, self._squared(self.work[at]))]
        self.squares = [np.sum(q, axis=0) for q in zip(*exchange(self.squares))]

    def _blocks(self) -> list[slice]:
        return [slice(k, k + FRAMES) for k in range(0, len(self.work), FRAMES)]

    def _sum(self, x):
        return sum(self.exchange(x))

    def _squared(self, movie: np.ndarray) -> list[np.ndarray]:
        return [np.where(r > self.threshold, r * r, 0).sum(0) for r in pursuit.pyramid(movie)]

    def best(self) -> tuple[float, int, int, int]:
        """(value, scale, y, x) of the highest place of all maps; of equal ones the finest, then the first."""
        maps = [np.sqrt(q) for q in self.squares]
        scale = int(np.argmax([m.max() for m in maps]))
        y, x = np.unravel_index(maps[scale].argmax(), maps[scale].shape)
        return float(maps[scale][y, x]), scale, int(y), int(x)

    def _mean(self, active: np.ndarray) -> np.ndarray | None:
        """The mean over the active frames of all parts."""
        at, total = np.flatnonzero(active), np.zeros(self.work.shape[1:])
        for k in range(0, len(at), FRAMES):
            total += self.work[at[k : k + FRAMES]].sum(0)
        total, n = (sum(x) for x in zip(*self.exchange((total, len(at)))))
        return total / n if n else None

    def take(self, scale: int, y: int, x: int) -> np.ndarray | None:
        """The weights of a place's region, which is taken out of the movie; None if no frame is active, which ends the search."""
        height, width = self.work.shape[1:]
        y, x, half = min(y * 2**scale + 2**scale // 2, height - 1), min(x * 2**scale + 2**scale // 2, width - 1), 3 * 2**scale // 2
        inside = np.zeros((height, width), bool)
        inside[max(0, y - half) : y - half + 3 * 2**scale, max(0, x - half) : x - half + 3 * 2**scale] = True
        lam = inside / np.sqrt(inside.sum())
        proj = self.work[:, inside] @ lam[inside]
        percentile, least = self.settings.active_percentile, self.threshold
        if percentile > 0:
            least = min(least, np.percentile(np.concatenate(self.exchange(proj)), percentile))
        active = proj > least
        for _ in range(3):
            mean = self._mean(active)
            if mean is None:
                return None
            inside, lam = pursuit.grow_on(mean, inside)
            proj = self.work[:, inside] @ lam[inside]
            active = proj > self.threshold
        if not self._sum(int(active.sum())):
            return None
        gain, part = pursuit.split_ratio(self.work[:, inside], lam[inside], self.threshold, self.exchange)
        if gain > 1.25:
            lam = np.zeros_like(lam)
            lam[inside] = np.where(part > part.max() / 5, part, 0)
            lam /= max(np.linalg.norm(lam), 1e-10)
            inside = lam > 0
            proj = self.work[:, inside] @ lam[inside]
            active = proj > self.threshold
            if not self._sum(int(active.sum())):
                return None
        self._remove(lam, np.flatnonzero(active), proj[active])
        return lam

    def _remove(self, lam: np.ndarray, active: np.ndarray, proj: np.ndarray) -> None:
        """Only active frames change, and of the maps what their templates see of the region."""
        change = [np.zeros(q.shape) for q in self.squares]
        for k in range(0, len(active), FRAMES):
            at = active[k : k + FRAMES]
            old = self._squared(self.work[at])
            self.work[at] -= proj[k : k + FRAMES, None, None] * lam
            change = [c + n - o for c, n, o in zip(change, self._squared(self.work[at]), old)]
        for k, (seen, c) in enumerate(zip(pursuit.pyramid(lam), zip(*self.exchange(change)))):
            rows, columns = np.nonzero(seen)
            box = slice(rows.min(), rows.max() + 1), slice(columns.min(), columns.max() + 1)
            self.squares[k][box] = np.maximum(self.squares[k] + np.sum(c, axis=0), 0)[box]

    def search(self) -> list[tuple[np.ndarray, int]]:
        """[(weights image, scale)] in the order found, the same in every part."""
        found: list[tuple[np.ndarray, int]] = []
        while len(found) < self.settings.max_rois:
            value, *place = self.best()
            if value < self.stop or (lam := self.take(*place)) is None:
                break
            found.append((lam * self.sd, place[0]))
        return found


def _at_once(connection: Connection) -> Connection:
    """What is sent does not wait to be joined by more."""
    with socket.socket(fileno=os.dup(connection.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return connection


class _Tasks:
    """What the tasks of a barrier stage hand to one another, in the order of their numbers.

    The stage's own exchange takes about a second each time, so it serves once, to say where the first task listens.
    A task that is lost ends the connection, and with it the stage, which Spark begins again.
    """

    def __init__(self) -> None:
        context = BarrierTaskContext.get()
        infos = context.getTaskInfos()
        self.rank = context.partitionId()
        host = infos[0].address.rpartition(":")[0]
        listener, key, port = None, os.urandom(16), 0
        if not self.rank:
            listener = Listener((host, 0), backlog=len(infos), authkey=key)
            port = listener.address[1]
        port, key = context.allGather(f"{port} {key.hex()}")[0].split()
        if listener:
            self.others = {}
            for _ in infos[1:]:
                other = _at_once(listener.accept())
                self.others[other.recv()] = other
            listener.close()
        else:
            self.first = _at_once(Client((host, int(port)), authkey=bytes.fromhex(key)))
            self.first.send(self.rank)

    def __call__(self, x: object) -> list:
        if self.rank:
            self.first.send(x)
            return self.first.recv()
        said = [x, *(self.others[k].recv() for k in sorted(self.others))]
        packed = ForkingPickler.dumps(said)
        for other in self.others.values():
            other.send_bytes(packed)
        return said


def pursued_in_parts(frames: DataFrame, counts: dict, tasks: int, height: int, width: int, settings: SparseSettings, highpass: int, rows: Callable, schema: str) -> DataFrame:
    """The regions of every plane as ``rows`` gives them. counts: plane -> frames, in order; tasks: how many can run at once."""
    from calspark.operators.detection import spans

    windows = -(-max(counts.values()) // highpass)
    dealt = spans(frames, highpass * -(-windows // tasks)).repartitionById(tasks, "span").sortWithinPartitions("plane", "frame").select("plane", "arr")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exchange = _Tasks()
        batches = ((plane, np.stack(part.to_numpy())) for pdf in it for plane, part in pdf["arr"].groupby(pdf["plane"]))
        nxt = next(batches, None)
        for plane in counts:
            held = [np.zeros((0, height * width))]
            while nxt is not None and nxt[0] == plane:
                held.append(nxt[1])
                nxt = next(batches, None)
            movie = np.concatenate(held)
            held.clear()
            part = Part(movie, height, width, settings, highpass, exchange)
            del movie
            found = part.search()
            if not exchange.rank:
                yield rows(found, plane)

    return dealt.mapInPandas(run, schema, barrier=True)
