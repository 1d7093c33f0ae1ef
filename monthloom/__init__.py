"""Monthly panel analytics and forecasting expressed as Spark DataFrame plans."""

from monthloom.session import build_session, checkpoint_root, scratch_dir
from monthloom.spec import PanelSpec

__all__ = ["PanelSpec", "build_session", "checkpoint_root", "scratch_dir"]
