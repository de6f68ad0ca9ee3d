"""repolith: repository, delivery and text analytics as DataFrame plans."""
