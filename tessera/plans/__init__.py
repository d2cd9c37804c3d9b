"""Domain plans: chains of operators over survey and panel tables."""
