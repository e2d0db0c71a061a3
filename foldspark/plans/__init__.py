"""Plans that join the operators into whole jobs."""
