"""From raw documents to token ids: the stages of ``replicalog.llm.stages``, under the names the driver asks for."""

from __future__ import annotations

from replicalog.llm.stages import STAGES, run

#: The stages learn, cluster and encode; no SQL states their rows. Tests hold them against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
