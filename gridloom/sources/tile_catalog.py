"""The tile providers of leaflet-providers 2.0.0 with their variants (None: the provider itself).

Provider, variant, address, attribution, greatest zoom, other options; what a variant lacks is the provider's. An attribution may name
another provider in braces, or the {year}. Those of OpenStreetMap, CartoDB and OpenTopoMap are shortened to their text.
"""

# fmt: off
PROVIDERS = [
    ("OpenStreetMap", None, "https://tile.openstreetmap.org/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors", 19, {}),
    ("OpenStreetMap", "Mapnik", None, None, None, {}),
    ("OpenStreetMap", "DE", "https://tile.openstreetmap.de/{z}/{x}/{y}.png", None, 18, {}),
    ("OpenStreetMap", "CH", "https://tile.osm.ch/switzerland/{z}/{x}/{y}.png", None, 18, {"bounds": "[[45, 5], [48, 11]]"}),
    ("OpenStreetMap", "France", "https://{s}.tile.openstreetmap.fr/osmfr/{z}/{x}/{y}.png", "&copy; OpenStreetMap France | {attribution.OpenStreetMap}", 20, {}),
    ("OpenStreetMap", "HOT", "https://{s}.tile.openstreetmap.fr/hot/{z}/{x}/{y}.png", "{attribution.OpenStreetMap}, Tiles style by <a href=\"https://www.hotosm.org/\" target=\"_blank\">Humanitarian OpenStreetMap Team</a> hosted by <a href=\"https://openstreetmap.fr/\" target=\"_blank\">OpenStreetMap France</a>", None, {}),
    ("OpenStreetMap", "BZH", "https://tile.openstreetmap.bzh/br/{z}/{x}/{y}.png", "{attribution.OpenStreetMap}, Tiles courtesy of <a href=\"http://www.openstreetmap.bzh/\" target=\"_blank\">Breton OpenStreetMap Team</a>", None, {"bounds": "[[46.2, -5.5], [50, 0.7]]"}),
    ("MapTilesAPI", None, "https://maptiles.p.rapidapi.com/{variant}/{z}/{x}/{y}.png?rapidapi-key={apikey}", "&copy; <a href=\"http://www.maptilesapi.com/\">MapTiles API</a>, {attribution.OpenStreetMap}", 19, {"variant": "en/map/v1", "apikey": "<insert your api key here>"}),
    ("MapTilesAPI", "OSMEnglish", None, None, None, {"variant": "en/map/v1"}),
    ("MapTilesAPI", "OSMFrancais", None, None, None, {"variant": "fr/map/v1"}),
    ("MapTilesAPI", "OSMEspagnol", None, None, None, {"variant": "es/map/v1"}),
    ("OpenSeaMap", None, "https://tiles.openseamap.org/seamark/{z}/{x}/{y}.png", "Map data: &copy; <a href=\"http://www.openseamap.org\">OpenSeaMap</a> contributors", None, {}),
    ("OPNVKarte", None, "https://tileserver.memomaps.de/tilegen/{z}/{x}/{y}.png", "Map <a href=\"https://memomaps.de/\">memomaps.de</a> <a href=\"http://creativecommons.org/licenses/by-sa/2.0/\">CC-BY-SA</a>, map data {attribution.OpenStreetMap}", 18, {}),
    ("OpenTopoMap", None, "https://{s}.tile.opentopomap.org/{z}/{x}/{y}.png", "Map data: {attribution.OpenStreetMap}, SRTM", 17, {}),
    ("OpenRailwayMap", None, "https://{s}.tiles.openrailwaymap.org/standard/{z}/{x}/{y}.png", "Map data: {attribution.OpenStreetMap} | Map style: &copy; <a href=\"https://www.OpenRailwayMap.org\">OpenRailwayMap</a> (<a href=\"https://creativecommons.org/licenses/by-sa/3.0/\">CC-BY-SA</a>)", 19, {}),
    ("OpenFireMap", None, "http://openfiremap.org/hytiles/{z}/{x}/{y}.png", "Map data: {attribution.OpenStreetMap} | Map style: &copy; <a href=\"http://www.openfiremap.org\">OpenFireMap</a> (<a href=\"https://creativecommons.org/licenses/by-sa/3.0/\">CC-BY-SA</a>)", 19, {}),
    ("SafeCast", None, "https://s3.amazonaws.com/te512.safecast.org/{z}/{x}/{y}.png", "Map data: {attribution.OpenStreetMap} | Map style: &copy; <a href=\"https://blog.safecast.org/about/\">SafeCast</a> (<a href=\"https://creativecommons.org/licenses/by-sa/3.0/\">CC-BY-SA</a>)", 16, {}),
    ("Stadia", None, "https://tiles.stadiamaps.com/tiles/{variant}/{z}/{x}/{y}{r}.{ext}", "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", 20, {"minZoom": "0", "variant": "alidade_smooth", "ext": "png"}),
    ("Stadia", "AlidadeSmooth", None, None, None, {"variant": "alidade_smooth"}),
    ("Stadia", "AlidadeSmoothDark", None, None, None, {"variant": "alidade_smooth_dark"}),
    ("Stadia", "OSMBright", None, None, None, {"variant": "osm_bright"}),
    ("Stadia", "Outdoors", None, None, None, {"variant": "outdoors"}),
    ("Stadia", "StamenToner", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", None, {"variant": "stamen_toner"}),
    ("Stadia", "StamenTonerBackground", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", None, {"variant": "stamen_toner_background"}),
    ("Stadia", "StamenTonerLines", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", None, {"variant": "stamen_toner_lines"}),
    ("Stadia", "StamenTonerLabels", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", None, {"variant": "stamen_toner_labels"}),
    ("Stadia", "StamenTonerLite", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", None, {"variant": "stamen_toner_lite"}),
    ("Stadia", "StamenWatercolor", "https://tiles.stadiamaps.com/tiles/{variant}/{z}/{x}/{y}.{ext}", "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", 16, {"variant": "stamen_watercolor", "ext": "jpg", "minZoom": "1"}),
    ("Stadia", "StamenTerrain", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", 18, {"variant": "stamen_terrain", "minZoom": "0"}),
    ("Stadia", "StamenTerrainBackground", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", 18, {"variant": "stamen_terrain_background", "minZoom": "0"}),
    ("Stadia", "StamenTerrainLabels", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", 18, {"variant": "stamen_terrain_labels", "minZoom": "0"}),
    ("Stadia", "StamenTerrainLines", None, "&copy; <a href=\"https://www.stadiamaps.com/\" target=\"_blank\">Stadia Maps</a> &copy; <a href=\"https://www.stamen.com/\" target=\"_blank\">Stamen Design</a> &copy; <a href=\"https://openmaptiles.org/\" target=\"_blank\">OpenMapTiles</a> {attribution.OpenStreetMap}", 18, {"variant": "stamen_terrain_lines", "minZoom": "0"}),
    ("Thunderforest", None, "https://{s}.tile.thunderforest.com/{variant}/{z}/{x}/{y}.png?apikey={apikey}", "&copy; <a href=\"http://www.thunderforest.com/\">Thunderforest</a>, {attribution.OpenStreetMap}", 22, {"variant": "cycle", "apikey": "<insert your api key here>"}),
    ("Thunderforest", "OpenCycleMap", None, None, None, {"variant": "cycle"}),
    ("Thunderforest", "Transport", None, None, None, {"variant": "transport"}),
    ("Thunderforest", "TransportDark", None, None, None, {"variant": "transport-dark"}),
    ("Thunderforest", "SpinalMap", None, None, None, {"variant": "spinal-map"}),
    ("Thunderforest", "Landscape", None, None, None, {"variant": "landscape"}),
    ("Thunderforest", "Outdoors", None, None, None, {"variant": "outdoors"}),
    ("Thunderforest", "Pioneer", None, None, None, {"variant": "pioneer"}),
    ("Thunderforest", "MobileAtlas", None, None, None, {"variant": "mobile-atlas"}),
    ("Thunderforest", "Neighbourhood", None, None, None, {"variant": "neighbourhood"}),
    ("CyclOSM", None, "https://{s}.tile-cyclosm.openstreetmap.fr/cyclosm/{z}/{x}/{y}.png", "<a href=\"https://github.com/cyclosm/cyclosm-cartocss-style/releases\" title=\"CyclOSM - Open Bicycle render\">CyclOSM</a> | Map data: {attribution.OpenStreetMap}", 20, {}),
    ("Jawg", None, "https://{s}.tile.jawg.io/{variant}/{z}/{x}/{y}{r}.png?access-token={accessToken}", "<a href=\"http://jawg.io\" title=\"Tiles Courtesy of Jawg Maps\" target=\"_blank\">&copy; <b>Jawg</b>Maps</a> {attribution.OpenStreetMap}", 22, {"minZoom": "0", "subdomains": "abcd", "variant": "jawg-terrain", "accessToken": "<insert your access token here>"}),
    ("Jawg", "Streets", None, None, None, {"variant": "jawg-streets"}),
    ("Jawg", "Terrain", None, None, None, {"variant": "jawg-terrain"}),
    ("Jawg", "Sunny", None, None, None, {"variant": "jawg-sunny"}),
    ("Jawg", "Dark", None, None, None, {"variant": "jawg-dark"}),
    ("Jawg", "Light", None, None, None, {"variant": "jawg-light"}),
    ("Jawg", "Matrix", None, None, None, {"variant": "jawg-matrix"}),
    ("MapBox", None, "https://api.mapbox.com/styles/v1/{id}/tiles/{z}/{x}/{y}{r}?access_token={accessToken}", "&copy; <a href=\"https://www.mapbox.com/about/maps/\" target=\"_blank\">Mapbox</a> {attribution.OpenStreetMap} <a href=\"https://www.mapbox.com/map-feedback/\" target=\"_blank\">Improve this map</a>", 18, {"tileSize": "512", "zoomOffset": "-1", "id": "mapbox/streets-v11", "accessToken": "<insert your access token here>"}),
    ("MapTiler", None, "https://api.maptiler.com/maps/{variant}/{z}/{x}/{y}{r}.{ext}?key={key}", "<a href=\"https://www.maptiler.com/copyright/\" target=\"_blank\">&copy; MapTiler</a> <a href=\"https://www.openstreetmap.org/copyright\" target=\"_blank\">&copy; OpenStreetMap contributors</a>", 21, {"variant": "streets", "ext": "png", "key": "<insert your MapTiler Cloud API key here>", "tileSize": "512", "zoomOffset": "-1", "minZoom": "0"}),
    ("MapTiler", "Streets", None, None, None, {"variant": "streets"}),
    ("MapTiler", "Basic", None, None, None, {"variant": "basic"}),
    ("MapTiler", "Bright", None, None, None, {"variant": "bright"}),
    ("MapTiler", "Pastel", None, None, None, {"variant": "pastel"}),
    ("MapTiler", "Positron", None, None, None, {"variant": "positron"}),
    ("MapTiler", "Hybrid", None, None, None, {"variant": "hybrid", "ext": "jpg"}),
    ("MapTiler", "Toner", None, None, None, {"variant": "toner"}),
    ("MapTiler", "Topo", None, None, None, {"variant": "topo"}),
    ("MapTiler", "Voyager", None, None, None, {"variant": "voyager"}),
    ("TomTom", None, "https://{s}.api.tomtom.com/map/1/tile/{variant}/{style}/{z}/{x}/{y}.{ext}?key={apikey}", "<a href=\"https://tomtom.com\" target=\"_blank\">&copy;  1992 - {year} TomTom.</a> ", 22, {"variant": "basic", "subdomains": "abcd", "style": "main", "ext": "png", "apikey": "<insert your API key here>"}),
    ("TomTom", "Basic", None, None, None, {"variant": "basic"}),
    ("TomTom", "Hybrid", None, None, None, {"variant": "hybrid"}),
    ("TomTom", "Labels", None, None, None, {"variant": "labels"}),
    ("Esri", None, "https://server.arcgisonline.com/ArcGIS/rest/services/{variant}/MapServer/tile/{z}/{y}/{x}", "Tiles &copy; Esri", None, {"variant": "World_Street_Map"}),
    ("Esri", "WorldStreetMap", None, "{attribution.Esri} &mdash; Source: Esri, DeLorme, NAVTEQ, USGS, Intermap, iPC, NRCAN, Esri Japan, METI, Esri China (Hong Kong), Esri (Thailand), TomTom, 2012", None, {}),
    ("Esri", "DeLorme", None, "{attribution.Esri} &mdash; Copyright: &copy;2012 DeLorme", 11, {"variant": "Specialty/DeLorme_World_Base_Map", "minZoom": "1"}),
    ("Esri", "WorldTopoMap", None, "{attribution.Esri} &mdash; Esri, DeLorme, NAVTEQ, TomTom, Intermap, iPC, USGS, FAO, NPS, NRCAN, GeoBase, Kadaster NL, Ordnance Survey, Esri Japan, METI, Esri China (Hong Kong), and the GIS User Community", None, {"variant": "World_Topo_Map"}),
    ("Esri", "WorldImagery", None, "{attribution.Esri} &mdash; Source: Esri, i-cubed, USDA, USGS, AEX, GeoEye, Getmapping, Aerogrid, IGN, IGP, UPR-EGP, and the GIS User Community", None, {"variant": "World_Imagery"}),
    ("Esri", "WorldTerrain", None, "{attribution.Esri} &mdash; Source: USGS, Esri, TANA, DeLorme, and NPS", 13, {"variant": "World_Terrain_Base"}),
    ("Esri", "WorldShadedRelief", None, "{attribution.Esri} &mdash; Source: Esri", 13, {"variant": "World_Shaded_Relief"}),
    ("Esri", "WorldPhysical", None, "{attribution.Esri} &mdash; Source: US National Park Service", 8, {"variant": "World_Physical_Map"}),
    ("Esri", "OceanBasemap", None, "{attribution.Esri} &mdash; Sources: GEBCO, NOAA, CHS, OSU, UNH, CSUMB, National Geographic, DeLorme, NAVTEQ, and Esri", 13, {"variant": "Ocean/World_Ocean_Base"}),
    ("Esri", "NatGeoWorldMap", None, "{attribution.Esri} &mdash; National Geographic, Esri, DeLorme, NAVTEQ, UNEP-WCMC, USGS, NASA, ESA, METI, NRCAN, GEBCO, NOAA, iPC", 16, {"variant": "NatGeo_World_Map"}),
    ("Esri", "WorldGrayCanvas", None, "{attribution.Esri} &mdash; Esri, DeLorme, NAVTEQ", 16, {"variant": "Canvas/World_Light_Gray_Base"}),
    ("OpenWeatherMap", None, "http://{s}.tile.openweathermap.org/map/{variant}/{z}/{x}/{y}.png?appid={apiKey}", "Map data &copy; <a href=\"http://openweathermap.org\">OpenWeatherMap</a>", 19, {"apiKey": "<insert your api key here>", "opacity": "0.5"}),
    ("OpenWeatherMap", "Clouds", None, None, None, {"variant": "clouds"}),
    ("OpenWeatherMap", "CloudsClassic", None, None, None, {"variant": "clouds_cls"}),
    ("OpenWeatherMap", "Precipitation", None, None, None, {"variant": "precipitation"}),
    ("OpenWeatherMap", "PrecipitationClassic", None, None, None, {"variant": "precipitation_cls"}),
    ("OpenWeatherMap", "Rain", None, None, None, {"variant": "rain"}),
    ("OpenWeatherMap", "RainClassic", None, None, None, {"variant": "rain_cls"}),
    ("OpenWeatherMap", "Pressure", None, None, None, {"variant": "pressure"}),
    ("OpenWeatherMap", "PressureContour", None, None, None, {"variant": "pressure_cntr"}),
    ("OpenWeatherMap", "Wind", None, None, None, {"variant": "wind"}),
    ("OpenWeatherMap", "Temperature", None, None, None, {"variant": "temp"}),
    ("OpenWeatherMap", "Snow", None, None, None, {"variant": "snow"}),
    ("HERE", None, "https://{s}.{base}.maps.api.here.com/maptile/2.1/{type}/{mapID}/{variant}/{z}/{x}/{y}/{size}/{format}?app_id={app_id}&app_code={app_code}&lg={language}", "Map &copy; 1987-{year} <a href=\"http://developer.here.com\">HERE</a>", 20, {"subdomains": "1234", "mapID": "newest", "app_id": "<insert your app_id here>", "app_code": "<insert your app_code here>", "base": "base", "variant": "normal.day", "type": "maptile", "language": "eng", "format": "png8", "size": "256"}),
    ("HERE", "normalDay", None, None, None, {"variant": "normal.day"}),
    ("HERE", "normalDayCustom", None, None, None, {"variant": "normal.day.custom"}),
    ("HERE", "normalDayGrey", None, None, None, {"variant": "normal.day.grey"}),
    ("HERE", "normalDayMobile", None, None, None, {"variant": "normal.day.mobile"}),
    ("HERE", "normalDayGreyMobile", None, None, None, {"variant": "normal.day.grey.mobile"}),
    ("HERE", "normalDayTransit", None, None, None, {"variant": "normal.day.transit"}),
    ("HERE", "normalDayTransitMobile", None, None, None, {"variant": "normal.day.transit.mobile"}),
    ("HERE", "normalDayTraffic", None, None, None, {"variant": "normal.traffic.day", "base": "traffic", "type": "traffictile"}),
    ("HERE", "normalNight", None, None, None, {"variant": "normal.night"}),
    ("HERE", "normalNightMobile", None, None, None, {"variant": "normal.night.mobile"}),
    ("HERE", "normalNightGrey", None, None, None, {"variant": "normal.night.grey"}),
    ("HERE", "normalNightGreyMobile", None, None, None, {"variant": "normal.night.grey.mobile"}),
    ("HERE", "normalNightTransit", None, None, None, {"variant": "normal.night.transit"}),
    ("HERE", "normalNightTransitMobile", None, None, None, {"variant": "normal.night.transit.mobile"}),
    ("HERE", "reducedDay", None, None, None, {"variant": "reduced.day"}),
    ("HERE", "reducedNight", None, None, None, {"variant": "reduced.night"}),
    ("HERE", "basicMap", None, None, None, {"type": "basetile"}),
    ("HERE", "mapLabels", None, None, None, {"type": "labeltile", "format": "png"}),
    ("HERE", "trafficFlow", None, None, None, {"base": "traffic", "type": "flowtile"}),
    ("HERE", "carnavDayGrey", None, None, None, {"variant": "carnav.day.grey"}),
    ("HERE", "hybridDay", None, None, None, {"base": "aerial", "variant": "hybrid.day"}),
    ("HERE", "hybridDayMobile", None, None, None, {"base": "aerial", "variant": "hybrid.day.mobile"}),
    ("HERE", "hybridDayTransit", None, None, None, {"base": "aerial", "variant": "hybrid.day.transit"}),
    ("HERE", "hybridDayGrey", None, None, None, {"base": "aerial", "variant": "hybrid.grey.day"}),
    ("HERE", "hybridDayTraffic", None, None, None, {"variant": "hybrid.traffic.day", "base": "traffic", "type": "traffictile"}),
    ("HERE", "pedestrianDay", None, None, None, {"variant": "pedestrian.day"}),
    ("HERE", "pedestrianNight", None, None, None, {"variant": "pedestrian.night"}),
    ("HERE", "satelliteDay", None, None, None, {"base": "aerial", "variant": "satellite.day"}),
    ("HERE", "terrainDay", None, None, None, {"base": "aerial", "variant": "terrain.day"}),
    ("HERE", "terrainDayMobile", None, None, None, {"base": "aerial", "variant": "terrain.day.mobile"}),
    ("HEREv3", None, "https://{s}.{base}.maps.ls.hereapi.com/maptile/2.1/{type}/{mapID}/{variant}/{z}/{x}/{y}/{size}/{format}?apiKey={apiKey}&lg={language}", "Map &copy; 1987-{year} <a href=\"http://developer.here.com\">HERE</a>", 20, {"subdomains": "1234", "mapID": "newest", "apiKey": "<insert your apiKey here>", "base": "base", "variant": "normal.day", "type": "maptile", "language": "eng", "format": "png8", "size": "256"}),
    ("HEREv3", "normalDay", None, None, None, {"variant": "normal.day"}),
    ("HEREv3", "normalDayCustom", None, None, None, {"variant": "normal.day.custom"}),
    ("HEREv3", "normalDayGrey", None, None, None, {"variant": "normal.day.grey"}),
    ("HEREv3", "normalDayMobile", None, None, None, {"variant": "normal.day.mobile"}),
    ("HEREv3", "normalDayGreyMobile", None, None, None, {"variant": "normal.day.grey.mobile"}),
    ("HEREv3", "normalDayTransit", None, None, None, {"variant": "normal.day.transit"}),
    ("HEREv3", "normalDayTransitMobile", None, None, None, {"variant": "normal.day.transit.mobile"}),
    ("HEREv3", "normalNight", None, None, None, {"variant": "normal.night"}),
    ("HEREv3", "normalNightMobile", None, None, None, {"variant": "normal.night.mobile"}),
    ("HEREv3", "normalNightGrey", None, None, None, {"variant": "normal.night.grey"}),
    ("HEREv3", "normalNightGreyMobile", None, None, None, {"variant": "normal.night.grey.mobile"}),
    ("HEREv3", "normalNightTransit", None, None, None, {"variant": "normal.night.transit"}),
    ("HEREv3", "normalNightTransitMobile", None, None, None, {"variant": "normal.night.transit.mobile"}),
    ("HEREv3", "reducedDay", None, None, None, {"variant": "reduced.day"}),
    ("HEREv3", "reducedNight", None, None, None, {"variant": "reduced.night"}),
    ("HEREv3", "basicMap", None, None, None, {"type": "basetile"}),
    ("HEREv3", "mapLabels", None, None, None, {"type": "labeltile", "format": "png"}),
    ("HEREv3", "trafficFlow", None, None, None, {"base": "traffic", "type": "flowtile"}),
    ("HEREv3", "carnavDayGrey", None, None, None, {"variant": "carnav.day.grey"}),
    ("HEREv3", "hybridDay", None, None, None, {"base": "aerial", "variant": "hybrid.day"}),
    ("HEREv3", "hybridDayMobile", None, None, None, {"base": "aerial", "variant": "hybrid.day.mobile"}),
    ("HEREv3", "hybridDayTransit", None, None, None, {"base": "aerial", "variant": "hybrid.day.transit"}),
    ("HEREv3", "hybridDayGrey", None, None, None, {"base": "aerial", "variant": "hybrid.grey.day"}),
    ("HEREv3", "pedestrianDay", None, None, None, {"variant": "pedestrian.day"}),
    ("HEREv3", "pedestrianNight", None, None, None, {"variant": "pedestrian.night"}),
    ("HEREv3", "satelliteDay", None, None, None, {"base": "aerial", "variant": "satellite.day"}),
    ("HEREv3", "terrainDay", None, None, None, {"base": "aerial", "variant": "terrain.day"}),
    ("HEREv3", "terrainDayMobile", None, None, None, {"base": "aerial", "variant": "terrain.day.mobile"}),
    ("FreeMapSK", None, "https://{s}.freemap.sk/T/{z}/{x}/{y}.jpeg", "{attribution.OpenStreetMap}, visualization CC-By-SA 2.0 <a href=\"http://freemap.sk\">Freemap.sk</a>", 16, {"minZoom": "8", "subdomains": "abcd", "bounds": "[[47.204642, 15.996093], [49.830896, 22.576904]]"}),
    ("MtbMap", None, "http://tile.mtbmap.cz/mtbmap_tiles/{z}/{x}/{y}.png", "{attribution.OpenStreetMap} &amp; USGS", None, {}),
    ("CartoDB", None, "https://{s}.basemaps.cartocdn.com/{variant}/{z}/{x}/{y}{r}.png", "{attribution.OpenStreetMap} &copy; CARTO", 20, {"subdomains": "abcd", "variant": "light_all"}),
    ("CartoDB", "Positron", None, None, None, {"variant": "light_all"}),
    ("CartoDB", "PositronNoLabels", None, None, None, {"variant": "light_nolabels"}),
    ("CartoDB", "PositronOnlyLabels", None, None, None, {"variant": "light_only_labels"}),
    ("CartoDB", "DarkMatter", None, None, None, {"variant": "dark_all"}),
    ("CartoDB", "DarkMatterNoLabels", None, None, None, {"variant": "dark_nolabels"}),
    ("CartoDB", "DarkMatterOnlyLabels", None, None, None, {"variant": "dark_only_labels"}),
    ("CartoDB", "Voyager", None, None, None, {"variant": "rastertiles/voyager"}),
    ("CartoDB", "VoyagerNoLabels", None, None, None, {"variant": "rastertiles/voyager_nolabels"}),
    ("CartoDB", "VoyagerOnlyLabels", None, None, None, {"variant": "rastertiles/voyager_only_labels"}),
    ("CartoDB", "VoyagerLabelsUnder", None, None, None, {"variant": "rastertiles/voyager_labels_under"}),
    ("HikeBike", None, "https://tiles.wmflabs.org/{variant}/{z}/{x}/{y}.png", "{attribution.OpenStreetMap}", 19, {"variant": "hikebike"}),
    ("HikeBike", "HikeBike", None, None, None, {}),
    ("HikeBike", "HillShading", None, None, 15, {"variant": "hillshading"}),
    ("BasemapAT", None, "https://mapsneu.wien.gv.at/basemap/{variant}/{type}/google3857/{z}/{y}/{x}.{format}", "Datenquelle: <a href=\"https://www.basemap.at\">basemap.at</a>", 19, {"type": "normal", "format": "png", "bounds": "[[46.35877, 8.782379], [49.037872, 17.189532]]", "variant": "geolandbasemap"}),
    ("BasemapAT", "basemap", None, None, 20, {"variant": "geolandbasemap"}),
    ("BasemapAT", "grau", None, None, None, {"variant": "bmapgrau"}),
    ("BasemapAT", "overlay", None, None, None, {"variant": "bmapoverlay"}),
    ("BasemapAT", "terrain", None, None, None, {"variant": "bmapgelaende", "type": "grau", "format": "jpeg"}),
    ("BasemapAT", "surface", None, None, None, {"variant": "bmapoberflaeche", "type": "grau", "format": "jpeg"}),
    ("BasemapAT", "highdpi", None, None, None, {"variant": "bmaphidpi", "format": "jpeg"}),
    ("BasemapAT", "orthofoto", None, None, 20, {"variant": "bmaporthofoto30cm", "format": "jpeg"}),
    ("nlmaps", None, "https://service.pdok.nl/brt/achtergrondkaart/wmts/v2_0/{variant}/EPSG:3857/{z}/{x}/{y}.png", "Kaartgegevens &copy; <a href=\"https://www.kadaster.nl\">Kadaster</a>", 19, {"minZoom": "6", "bounds": "[[50.5, 3.25], [54, 7.6]]"}),
    ("nlmaps", "standaard", None, None, None, {"variant": "standaard"}),
    ("nlmaps", "pastel", None, None, None, {"variant": "pastel"}),
    ("nlmaps", "grijs", None, None, None, {"variant": "grijs"}),
    ("nlmaps", "water", None, None, None, {"variant": "water"}),
    ("nlmaps", "luchtfoto", "https://service.pdok.nl/hwh/luchtfotorgb/wmts/v1_0/Actueel_ortho25/EPSG:3857/{z}/{x}/{y}.jpeg", None, None, {}),
    ("NASAGIBS", None, "https://map1.vis.earthdata.nasa.gov/wmts-webmerc/{variant}/default/{time}/{tilematrixset}{maxZoom}/{z}/{y}/{x}.{format}", "Imagery provided by services from the Global Imagery Browse Services (GIBS), operated by the NASA/GSFC/Earth Science Data and Information System (<a href=\"https://earthdata.nasa.gov\">ESDIS</a>) with funding provided by NASA/HQ.", 9, {"bounds": "[[-85.0511287776, -179.999999975], [85.0511287776, 179.999999975]]", "minZoom": "1", "format": "jpg", "time": "", "tilematrixset": "GoogleMapsCompatible_Level"}),
    ("NASAGIBS", "ModisTerraTrueColorCR", None, None, None, {"variant": "MODIS_Terra_CorrectedReflectance_TrueColor"}),
    ("NASAGIBS", "ModisTerraBands367CR", None, None, None, {"variant": "MODIS_Terra_CorrectedReflectance_Bands367"}),
    ("NASAGIBS", "ViirsEarthAtNight2012", None, None, 8, {"variant": "VIIRS_CityLights_2012"}),
    ("NASAGIBS", "ModisTerraLSTDay", None, None, 7, {"variant": "MODIS_Terra_Land_Surface_Temp_Day", "format": "png", "opacity": "0.75"}),
    ("NASAGIBS", "ModisTerraSnowCover", None, None, 8, {"variant": "MODIS_Terra_NDSI_Snow_Cover", "format": "png", "opacity": "0.75"}),
    ("NASAGIBS", "ModisTerraAOD", None, None, 6, {"variant": "MODIS_Terra_Aerosol", "format": "png", "opacity": "0.75"}),
    ("NASAGIBS", "ModisTerraChlorophyll", None, None, 7, {"variant": "MODIS_Terra_Chlorophyll_A", "format": "png", "opacity": "0.75"}),
    ("NLS", None, "https://nls-{s}.tileserver.com/nls/{z}/{x}/{y}.jpg", "<a href=\"http://geo.nls.uk/maps/\">National Library of Scotland Historic Maps</a>", 18, {"bounds": "[[49.6, -12], [61.7, 3]]", "minZoom": "1", "subdomains": "0123"}),
    ("JusticeMap", None, "https://www.justicemap.org/tile/{size}/{variant}/{z}/{x}/{y}.png", "<a href=\"http://www.justicemap.org/terms.php\">Justice Map</a>", None, {"size": "county", "bounds": "[[14, -180], [72, -56]]"}),
    ("JusticeMap", "income", None, None, None, {"variant": "income"}),
    ("JusticeMap", "americanIndian", None, None, None, {"variant": "indian"}),
    ("JusticeMap", "asian", None, None, None, {"variant": "asian"}),
    ("JusticeMap", "black", None, None, None, {"variant": "black"}),
    ("JusticeMap", "hispanic", None, None, None, {"variant": "hispanic"}),
    ("JusticeMap", "multi", None, None, None, {"variant": "multi"}),
    ("JusticeMap", "nonWhite", None, None, None, {"variant": "nonwhite"}),
    ("JusticeMap", "white", None, None, None, {"variant": "white"}),
    ("JusticeMap", "plurality", None, None, None, {"variant": "plural"}),
    ("GeoportailFrance", None, "https://wxs.ign.fr/{apikey}/geoportail/wmts?REQUEST=GetTile&SERVICE=WMTS&VERSION=1.0.0&STYLE={style}&TILEMATRIXSET=PM&FORMAT={format}&LAYER={variant}&TILEMATRIX={z}&TILEROW={y}&TILECOL={x}", "<a target=\"_blank\" href=\"https://www.geoportail.gouv.fr/\">Geoportail France</a>", 18, {"bounds": "[[-75, -180], [81, 180]]", "minZoom": "2", "apikey": "choisirgeoportail", "format": "image/png", "style": "normal", "variant": "GEOGRAPHICALGRIDSYSTEMS.PLANIGNV2"}),
    ("GeoportailFrance", "plan", None, None, None, {"variant": "GEOGRAPHICALGRIDSYSTEMS.PLANIGNV2"}),
    ("GeoportailFrance", "parcels", None, None, 20, {"variant": "CADASTRALPARCELS.PARCELLAIRE_EXPRESS", "style": "PCI vecteur"}),
    ("GeoportailFrance", "orthos", None, None, 19, {"format": "image/jpeg", "variant": "ORTHOIMAGERY.ORTHOPHOTOS"}),
    ("OneMapSG", None, "https://maps-{s}.onemap.sg/v3/{variant}/{z}/{x}/{y}.png", "<img src=\"https://docs.onemap.sg/maps/images/oneMap64-01.png\" style=\"height:20px;width:20px;\"/> New OneMap | Map data &copy; contributors, <a href=\"http://SLA.gov.sg\">Singapore Land Authority</a>", 18, {"variant": "Default", "minZoom": "11", "bounds": "[[1.56073, 104.11475], [1.16, 103.502]]"}),
    ("OneMapSG", "Default", None, None, None, {"variant": "Default"}),
    ("OneMapSG", "Night", None, None, None, {"variant": "Night"}),
    ("OneMapSG", "Original", None, None, None, {"variant": "Original"}),
    ("OneMapSG", "Grey", None, None, None, {"variant": "Grey"}),
    ("OneMapSG", "LandLot", None, None, None, {"variant": "LandLot"}),
    ("USGS", None, "https://basemap.nationalmap.gov/arcgis/rest/services/USGSTopo/MapServer/tile/{z}/{y}/{x}", "Tiles courtesy of the <a href=\"https://usgs.gov/\">U.S. Geological Survey</a>", 20, {}),
    ("USGS", "USTopo", None, None, None, {}),
    ("USGS", "USImagery", "https://basemap.nationalmap.gov/arcgis/rest/services/USGSImageryOnly/MapServer/tile/{z}/{y}/{x}", None, None, {}),
    ("USGS", "USImageryTopo", "https://basemap.nationalmap.gov/arcgis/rest/services/USGSImageryTopo/MapServer/tile/{z}/{y}/{x}", None, None, {}),
    ("WaymarkedTrails", None, "https://tile.waymarkedtrails.org/{variant}/{z}/{x}/{y}.png", "Map data: {attribution.OpenStreetMap} | Map style: &copy; <a href=\"https://waymarkedtrails.org\">waymarkedtrails.org</a> (<a href=\"https://creativecommons.org/licenses/by-sa/3.0/\">CC-BY-SA</a>)", 18, {}),
    ("WaymarkedTrails", "hiking", None, None, None, {"variant": "hiking"}),
    ("WaymarkedTrails", "cycling", None, None, None, {"variant": "cycling"}),
    ("WaymarkedTrails", "mtb", None, None, None, {"variant": "mtb"}),
    ("WaymarkedTrails", "slopes", None, None, None, {"variant": "slopes"}),
    ("WaymarkedTrails", "riding", None, None, None, {"variant": "riding"}),
    ("WaymarkedTrails", "skating", None, None, None, {"variant": "skating"}),
    ("OpenAIP", None, "https://{s}.tile.maps.openaip.net/geowebcache/service/tms/1.0.0/openaip_basemap@EPSG%3A900913@png/{z}/{x}/{y}.{ext}", "<a href=\"https://www.openaip.net/\">openAIP Data</a> (<a href=\"https://creativecommons.org/licenses/by-sa/3.0/\">CC-BY-NC-SA</a>)", 14, {"ext": "png", "minZoom": "4", "tms": "true", "detectRetina": "true", "subdomains": "12"}),
    ("OpenSnowMap", None, "https://tiles.opensnowmap.org/{variant}/{z}/{x}/{y}.png", "Map data: {attribution.OpenStreetMap} & ODbL, &copy; <a href=\"https://www.opensnowmap.org/iframes/data.html\">www.opensnowmap.org</a> <a href=\"https://creativecommons.org/licenses/by-sa/2.0/\">CC-BY-SA</a>", 18, {"minZoom": "9"}),
    ("OpenSnowMap", "pistes", None, None, None, {"variant": "pistes"}),
    ("AzureMaps", None, "https://atlas.microsoft.com/map/tile?api-version={apiVersion}&tilesetId={variant}&x={x}&y={y}&zoom={z}&language={language}&subscription-key={subscriptionKey}", "See https://docs.microsoft.com/en-us/rest/api/maps/render-v2/get-map-tile for details.", None, {"apiVersion": "2.0", "variant": "microsoft.imagery", "subscriptionKey": "<insert your subscription key here>", "language": "en-US"}),
    ("AzureMaps", "MicrosoftImagery", None, None, None, {"variant": "microsoft.imagery"}),
    ("AzureMaps", "MicrosoftBaseDarkGrey", None, None, None, {"variant": "microsoft.base.darkgrey"}),
    ("AzureMaps", "MicrosoftBaseRoad", None, None, None, {"variant": "microsoft.base.road"}),
    ("AzureMaps", "MicrosoftBaseHybridRoad", None, None, None, {"variant": "microsoft.base.hybrid.road"}),
    ("AzureMaps", "MicrosoftTerraMain", None, None, None, {"variant": "microsoft.terra.main"}),
    ("AzureMaps", "MicrosoftWeatherInfraredMain", "https://atlas.microsoft.com/map/tile?api-version={apiVersion}&tilesetId={variant}&x={x}&y={y}&zoom={z}&timeStamp={timeStamp}&language={language}&subscription-key={subscriptionKey}", "See https://docs.microsoft.com/en-us/rest/api/maps/render-v2/get-map-tile#uri-parameters for details.", None, {"timeStamp": "2021-05-08T09:03:00Z", "variant": "microsoft.weather.infrared.main"}),
    ("AzureMaps", "MicrosoftWeatherRadarMain", "https://atlas.microsoft.com/map/tile?api-version={apiVersion}&tilesetId={variant}&x={x}&y={y}&zoom={z}&timeStamp={timeStamp}&language={language}&subscription-key={subscriptionKey}", "See https://docs.microsoft.com/en-us/rest/api/maps/render-v2/get-map-tile#uri-parameters for details.", None, {"timeStamp": "2021-05-08T09:03:00Z", "variant": "microsoft.weather.radar.main"}),
    ("SwissFederalGeoportal", None, "https://wmts.geo.admin.ch/1.0.0/{variant}/default/current/3857/{z}/{x}/{y}.jpeg", "&copy; <a href=\"https://www.swisstopo.admin.ch/\">swisstopo</a>", 18, {"minZoom": "2", "bounds": "[[45.398181, 5.140242], [48.230651, 11.47757]]"}),
    ("SwissFederalGeoportal", "NationalMapColor", None, None, None, {"variant": "ch.swisstopo.pixelkarte-farbe"}),
    ("SwissFederalGeoportal", "NationalMapGrey", None, None, None, {"variant": "ch.swisstopo.pixelkarte-grau"}),
    ("SwissFederalGeoportal", "SWISSIMAGE", None, None, 19, {"variant": "ch.swisstopo.swissimage"}),
]
# fmt: on
