"""expstudy sub-package."""
