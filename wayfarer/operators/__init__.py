"""The mobility hierarchy: staypoints, triplegs, locations, trips and tours."""
